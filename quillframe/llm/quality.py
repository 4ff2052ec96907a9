"""Quality rules: distance between a document's histograms and those of languages.

One pass counts, per document, the base figures, a histogram of characters by
class and one of common words. Each language's reference is the sum of its
documents' histograms over the whole table. A document is rejected when its
characters, or its words, are further than a limit (Jensen-Shannon distance, base
2, so 0 to 1) from every language's reference. Short texts are not judged:
``min_chars`` and ``min_words`` guard the two distances.

Nulls count as empty text; empty and short texts get their figures and are kept
unless the base rule fails; texts are read whole; repeated rows are judged alike;
an empty table gives an empty result. Rows whose language is null feed no reference
and are judged by all. A row that states a language without a reference is judged by the
base rule alone: its distances, still given, say nothing about it. Without any reference nothing is rejected.
Only the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import map_rows, stored, utf8

# Common words of each language (own choice, lower case).
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were there one all we can has more if will so".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la mais comme ou si leur y dont aux avec cette ces ont son".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son".split(),
}
WORDS = sorted({w for words in COMMON_WORDS.values() for w in words})
# Classes of characters, by byte of the text: the first byte of a longer character stands for it.
CLASSES = ("lower", "upper", "digit", "space", "sentence mark", "symbol", "other mark", "beyond ASCII")
SYMBOLS = b"#*$%&|<>"
MIN_CHARS, MIN_WORDS = 400, 80
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.22, 0.325
REPEAT_WINDOW = 8
# Bytes between words.
_SPACE = b" \t\n\v\f\r"


def _class_table() -> np.ndarray:
    kind = np.zeros((256, len(CLASSES)), np.int64)
    for b in range(256):
        c = bytes([b])
        if 0x80 <= b < 0xC0:
            continue
        if b >= 0xC0:
            at = 7
        elif c.islower():
            at = 0
        elif c.isupper():
            at = 1
        elif c.isdigit():
            at = 2
        elif c in _SPACE:
            at = 3
        elif c in b".,;:'\"-()":
            at = 4
        elif c in SYMBOLS:
            at = 5
        else:
            at = 6
        kind[b, at] = 1
    return kind


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of words found twice or more.

    A rolling hash over the words' hashes finds windows that may repeat; those
    are compared word by word.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums, factor = np.zeros(n, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for i in range(window):
        sums = sums * factor + codes[i : i + n]
    order = np.sort(sums)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(sums, twice)).tolist()
    found: dict[tuple, list[int]] = {}
    for i in starts:
        found.setdefault(tuple(words[i : i + window]), []).append(i)
    edges = np.zeros(len(words) + 1, np.int64)
    for places in found.values():
        if len(places) > 1:
            at = np.array(places)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def repeated_lines(lines: list[bytes]) -> int:
    """Lines with a word that equal an earlier line."""
    return sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.strip(_SPACE))


def figures(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: dict[str, Column] | None = None,
    references: dict[str, dict[str, list[float]]] | None = None,
) -> DataFrame:
    """Base figures and both histograms of every whole text, in one pass without a shuffle; with ``references`` distances too."""
    keep = keep or {}
    kinds = df.select(*[c.alias(n) for n, c in keep.items()]).schema if keep else []
    columns = {"id": F.col(f"`{id_col}`"), **keep, "text": utf8(text_col)}
    id_kind = df.schema[id_col].dataType.simpleString()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = ", ".join(
        [f"id {id_kind}", *[f"{f.name} {f.dataType.simpleString()}" for f in kinds], *[f"{c} long" for c in counts]]
    )
    schema += ", chars array<long>, words array<long>"
    if references is not None:
        schema += ", char_distance double, word_distance double"

    names = ["id", *keep]

    def make():
        classes = _class_table()
        symbols, spaces = list(SYMBOLS), list(_SPACE)
        place = [(w.encode(), i) for i, w in enumerate(WORDS)]

        def work(given: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {n: given[n] for n in names} | {c: [] for c in (*counts, "chars", "words")}
            for t in given["text"]:
                words = t.split()
                bytes_ = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
                by_class = bytes_ @ classes
                seen = Counter(t.lower().split())
                common = [0] * (len(WORDS) + 1)
                for w, i in place:
                    common[i] = seen[w]
                common[-1] = len(words) - sum(common)
                out["n_words"].append(len(words))
                out["word_chars"].append(int(by_class.sum() - bytes_[spaces].sum()))
                out["n_symbols"].append(int(bytes_[symbols].sum()))
                out["n_dup_lines"].append(repeated_lines(t.split(b"\n")))
                out["n_repeat_words"].append(repeated_words(words))
                out["chars"].append(by_class.tolist())
                out["words"].append(common)
            if references is not None:
                out["char_distance"] = nearest(out["chars"], references["chars"])
                out["word_distance"] = nearest(out["words"], references["words"])
            return out

        return work

    return map_rows(df, columns, make, schema)


def fit_references(counted: DataFrame, lang: str = "lang") -> dict[str, dict[str, list[float]]]:
    """Shares by language over all documents; at most one small row per known language is collected."""
    sums = [
        F.sum(F.element_at(column, i + 1)).alias(f"{column}_{i}")
        for column, n in (("chars", len(CLASSES)), ("words", len(WORDS) + 1))
        for i in range(n)
    ]
    rows = counted.filter(F.col(lang).isin(list(COMMON_WORDS))).groupBy(lang).agg(*sums).collect()
    references: dict[str, dict[str, list[float]]] = {"chars": {}, "words": {}}
    for row in rows:
        for column, n in (("chars", len(CLASSES)), ("words", len(WORDS) + 1)):
            values = [row[f"{column}_{i}"] for i in range(n)]
            if sum(values):
                references[column][row[lang]] = [v / sum(values) for v in values]
    return references


def jensen_shannon(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Distance of each row of counts from one distribution; rows without counts get 1."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    q = np.broadcast_to(reference, p.shape)
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / middle), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / middle), 0).sum(axis=1)
    gap = np.sqrt(np.clip((left + right) / 2, 0, 1))
    return np.where(total[:, 0] > 0, gap, 1.0)


def nearest(counts: list, references: dict[str, list[float]]) -> np.ndarray:
    """The least distance of each row of counts from the references; 0 if there are none."""
    if not len(counts) or not references:
        return np.zeros(len(counts))
    rows = np.stack(counts)
    return np.min([jensen_shannon(rows, np.array(r)) for r in references.values()], axis=0)


def quality(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    keep: dict[str, Column] | None = None,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """(id, *keep, the base figures, base_failed, char_distance, word_distance, kept).

    The figures are stored once in the shared folder; references and distances
    both read them, so texts are read once. With columns to ``keep``, texts are
    read twice instead, as storing those columns could cost more.
    """
    lang = {"ref_lang": F.col(f"`{lang_col}`")}
    if keep:
        references = fit_references(figures(df, id_col, text_col, lang), "ref_lang")
        out = figures(df, id_col, text_col, lang | keep, references)
    else:
        counted = stored(figures(df, id_col, text_col, lang), "quality-figures")
        references = fit_references(counted, "ref_lang")

        def distance(column: str) -> Column:
            known = references[column]
            measure = F.pandas_udf(lambda counts: pd.Series(nearest(counts.to_numpy(), known), dtype="float64"), "double")
            return measure(F.col(column))

        out = counted.withColumn("char_distance", distance("chars")).withColumn("word_distance", distance("words"))

    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda a, b: a + b)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged_by = sorted(references["chars"].keys() | references["words"].keys())
    judged = F.col("ref_lang").isNull() | F.col("ref_lang").isin(judged_by)
    far = ((n_chars >= min_chars) & (F.col("char_distance") > max_char_distance)) | (
        (F.col("n_words") >= min_words) & (F.col("word_distance") > max_word_distance)
    )
    return (
        out.withColumn("base_failed", base)
        .withColumn("kept", ~base & ~(far & judged))
        .drop("chars", "words", "ref_lang")
    )


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that ``quality`` keeps, with their columns as they were."""
    whole = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(df.columns)}
    judged = quality(df, id_col, text_col, lang_col, keep=whole).filter("kept")
    return judged.select(*[F.col(n).alias(c) for n, c in zip(whole, df.columns, strict=True)])
