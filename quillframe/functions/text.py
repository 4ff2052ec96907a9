"""Text, prompt, screening and tool-output columns, all JVM-side built-ins."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions import fixed_values as V

# White space as Python's str.strip and re see it: Unicode spaces and FS to US.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_SPACE = r"[\s\x1c-\x1f]"
# Letters that match another letter when case is ignored but are not its upper
# case, such as the long s.
_VARIANTS = {"\u0130": "i"} | {
    c: c.upper().lower()
    for c in map(chr, range(0x10000))
    if len(c.upper().lower()) == 1 and c.upper().lower() != c.lower()
}
# Every line break Python's str.splitlines honours.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def python_regex(pattern: str, ignore_case: bool = False) -> str:
    """A Python ``re`` text pattern with the same matches in Java."""
    flags = "(?iuU)" if ignore_case else "(?U)"
    return flags + pattern.replace(r"\s", _SPACE)


def _literal_head(pattern: str) -> str:
    """Plain text every match must begin with; empty when there is none."""
    found = re.match(r"(?:\\b)?((?:\\\.)?[\w<]*)([?*{|]?)", pattern)
    head = found[1].replace("\\.", ".")
    return head[:-1] if found[2] else head


def once(col: Column, use: Callable[[Column], Column]) -> Column:
    """``use(col)`` with ``col`` computed a single time per row."""
    return F.get(F.transform(F.array(col), use), F.lit(0))


def rest_of(items: Column) -> Column:
    """All elements of an array but the first."""
    return F.slice(items, F.lit(2), F.size(items))


def strip_text(col: Column) -> Column:
    return F.btrim(col, F.lit(_SPACES))


def _pattern_hits(texts: Column, patterns: Sequence[str], ignore_case: bool) -> list[Column]:
    """One condition per pattern on struct(text, folded).

    A plain substring search for the pattern's literal head goes first, so the
    regular expression runs on the few texts that contain it; inside those it
    only starts where the head stands.
    """
    hits = []
    for p in patterns:
        head = _literal_head(p)
        regex = p if not head else f"(?={re.escape(head)}){p}"
        hit = texts["text"].rlike(python_regex(regex, ignore_case))
        if head:
            hit = texts["folded"].contains(head.lower() if ignore_case else head) & hit
        hits.append(hit)
    return hits


def _searched(col: Column, ignore_case: bool) -> Column:
    folded = F.lower(F.translate(col, "".join(_VARIANTS), "".join(_VARIANTS.values())))
    folded = folded if ignore_case else col
    return F.struct(col.alias("text"), folded.alias("folded"))


def _first_match(col: Column, patterns: Sequence[str], ignore_case: bool) -> Column:
    """Number, from 1, of the first pattern found, else NULL."""
    return once(
        _searched(col, ignore_case),
        lambda t: F.coalesce(
            *[F.when(h, F.lit(i)) for i, h in enumerate(_pattern_hits(t, patterns, ignore_case), 1)]
        ),
    )


def has_injection(col: Column) -> Column:
    return injection_number(col).isNotNull()


def injection_number(col: Column) -> Column:
    return _first_match(col, V.INJECTION_PATTERNS, True)


def cleaned_instruction(col: Column, limit: int = V.MAX_INSTRUCTION_CHARS) -> Column:
    """Stripped and cut to ``limit`` characters; missing becomes empty."""
    return F.substring(strip_text(F.coalesce(col, F.lit(""))), 1, limit)


def sanitize_instruction(col: Column) -> Column:
    """struct(cleaned, suspicious); the flag looks at the cut text only."""
    return once(
        cleaned_instruction(col),
        lambda c: F.struct(c.alias("cleaned"), has_injection(c).alias("suspicious")),
    )


def screen_code(col: Column) -> Column:
    """struct(safe, reason, pattern_no); the first pattern in list order is the reason."""
    names = F.array(*[F.lit(V.REFUSAL_PREFIX + p) for p in V.CODE_PATTERNS])
    return once(
        _first_match(F.coalesce(col, F.lit("")), V.CODE_PATTERNS, False),
        lambda number: F.struct(
            number.isNull().alias("safe"),
            F.coalesce(F.get(names, number - 1), F.lit("")).alias("reason"),
            number.alias("pattern_no"),
        ),
    )


def truncate_marked(col: Column, limit: int = V.MAX_OUTPUT_CHARS) -> Column:
    mark = F.lit(V.CUT_MARK.format(limit=limit))
    return F.when(
        F.length(col) > limit, F.concat(F.substring(col, 1, limit), mark)
    ).otherwise(col)


def preview(col: Column, limit: int = V.PREVIEW_CHARS) -> Column:
    return F.substring(col, 1, limit)


def assemble_output(
    stdout: Column, error: Column, charts_added: Column, charts_total: Column
) -> Column:
    """Non-empty parts with a blank line between, a default when there is none."""
    out = strip_text(F.coalesce(stdout, F.lit("")))
    head, rest = V.CHARTS_SAVED.replace("{limit}", str(V.MAX_CHARTS)).split("{added}")
    middle, tail = rest.split("{total}")
    charts = F.concat(
        F.lit(head), charts_added.cast("string"), F.lit(middle),
        charts_total.cast("string"), F.lit(tail),
    )
    joined = F.concat_ws(
        "\n\n",
        F.when(out != "", F.concat(F.lit(V.STDOUT_LABEL), out)),
        F.when(error != "", F.concat(F.lit(V.EXCEPTION_LABEL), strip_text(error))),
        F.when(charts_added > 0, charts),
    )
    return truncate_marked(F.when(joined != "", joined).otherwise(F.lit(V.NO_OUTPUT)))


def moderation_prompt(comment: Column) -> Column:
    """NULL for a missing comment, which the verdict step routes to ``uncertain``."""
    return F.concat(F.lit(V.MODERATION_PROMPT), comment)


def chat_messages(system: Column, user: Column) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", system), message("user", user))


def user_message(schema_block: Column, instruction: Column, suspicious: Column) -> Column:
    """Schema block, then the instruction as marked data, or the general request."""

    def wrapped(opening: str, note: str) -> Column:
        return F.concat(
            F.lit(opening + "\n"), instruction, F.lit("\n" + V.CLOSE_TAG + "\n" + note)
        )

    body = (
        F.when(F.coalesce(instruction, F.lit("")) == "", F.lit(V.NOTE_NONE))
        .when(suspicious, wrapped(V.OPEN_SUSPICIOUS, V.NOTE_SUSPICIOUS))
        .otherwise(wrapped(V.OPEN_PLAIN, V.NOTE_PLAIN))
    )
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit(V.MESSAGE_SCHEMA + "\n"), schema_block),
        body,
        F.lit(V.MESSAGE_END),
    )


def call_type(tool: Column) -> Column:
    return F.when(tool == V.TOOL_NAME, F.lit("tool_call")).otherwise(F.lit("unknown_tool"))


def shown_in_trace(event_type: Column) -> Column:
    return event_type.isin("tool_call", "model_error")
