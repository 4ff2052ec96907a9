"""Written reports as nested columns: parsing and completeness, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions import fixed_values as V
from quillframe.functions.text import LINE_BREAK, rest_of, strip_text

# All three are line breaks, so no line can contain them after splitting.
_SECTION, _BULLET, _MORE = "\x1c", "\x1d", "\x1e"


def _tagged_line(line: Column) -> Column:
    marks = "[" + "".join("\\" + m for m in V.BULLET_MARKS) + "]"
    bullet = strip_text(F.regexp_replace(line, r"^[\-*• ]+", ""))
    return (
        F.when(line == "", F.lit(""))
        .when(
            line.rlike(V.REPORT_HEADER),
            F.concat(F.lit(_SECTION), F.regexp_replace(line, ":+$", "")),
        )
        .when(line.rlike("^" + marks), F.concat(F.lit(_BULLET), bullet))
        .otherwise(F.concat(F.lit(_MORE), line))
    )


def parse_report(text: Column) -> Column:
    """array<struct<title, bullets>>.

    Each line is tagged as header, bullet or continuation and the tags are then
    split on. One linear pass over the text inside its own row: no window and
    no shuffle, whatever the number of reports.
    """
    lines = F.split(F.coalesce(text, F.lit("")), LINE_BREAK, -1)
    tagged = F.concat(
        F.lit(_SECTION),
        F.array_join(F.transform(F.transform(lines, strip_text), _tagged_line), ""),
    )
    # A continuation right behind a title has no bullet to join: it opens one.
    opened = F.regexp_replace(
        tagged, f"({_SECTION}[^{_SECTION}{_BULLET}{_MORE}]*){_MORE}", f"$1{_BULLET}"
    )
    folded = F.replace(opened, F.lit(_MORE), F.lit(" "))
    blocks = rest_of(F.split(folded, _SECTION, -1))

    def section(block: Column) -> Column:
        parts = F.split(block, _BULLET, -1)
        return F.struct(
            F.get(parts, F.lit(0)).alias("title"),
            rest_of(parts).alias("bullets"),
        )

    sections = F.transform(blocks, section)
    return F.filter(sections, lambda s: (s["title"] != "") | (F.size(s["bullets"]) > 0))


def raw_fallback(text: Column, sections: Column) -> Column:
    """The text itself where no section was found in it."""
    return F.when((F.size(sections) == 0) & (text != ""), text)


def section_bullets(sections: Column, title: str) -> Column:
    chosen = F.filter(sections, lambda s: s["title"] == title)
    return F.flatten(F.transform(chosen, lambda s: s["bullets"]))


def report_quality(sections: Column, charts: Column) -> Column:
    """struct of counts and of the five completeness rules."""
    present = F.size(
        F.array_distinct(
            F.transform(
                F.filter(sections, lambda s: s["title"].isin(*V.REPORT_SECTIONS)),
                lambda s: s["title"],
            )
        )
    )
    figures = F.size(section_bullets(sections, V.SECTION_FIGURES))
    found = section_bullets(sections, V.SECTION_FINDINGS)
    findings = F.size(found)
    numbered = F.size(F.filter(found, lambda b: b.rlike("[0-9]")))
    advice = F.size(section_bullets(sections, V.SECTION_ADVICE))
    rules = {
        "has_sections": present == len(V.REPORT_SECTIONS),
        "has_figures": figures >= 5,
        "has_findings": (findings >= 5) & (numbered == findings),
        "has_advice": advice.between(4, 6),
        "has_charts": charts >= 3,
    }
    all_met = F.lit(True)
    for rule in rules.values():
        all_met = all_met & rule
    counts = {
        "sections": present, "figures": figures, "findings": findings,
        "numbered_findings": numbered, "advice": advice,
    }
    return F.struct(
        *[c.cast("bigint").alias(n) for n, c in counts.items()],
        *[c.alias(n) for n, c in rules.items()],
        all_met.alias("complete"),
    )
