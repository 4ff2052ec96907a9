"""URL rules by host and path, and a weighted vocabulary found by one automaton.

The longest rule that fits a URL decides. Without one, an Aho-Corasick automaton
finds all vocabulary terms in host and path at once; a term counts when no
letter or digit adjoins it. One strict term, or several different soft terms whose weights
reach ``soft_limit``, block the URL. A soft term that names a topic weighs 4, a word that ordinary
sites use as well weighs 1, so no soft term blocks alone, nor do four everyday words without a topic.

A null URL, or one without ``://``, has an empty host and path, no rule and is
allowed. URLs are read whole, repeated rows are judged alike, an empty table
gives an empty result, and only the named columns are read. Equally long rules
are told apart by the longer host.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import map_rows

# Terms that block alone, by category (own choice).
STRICT = {
    "adult": ("camgirls", "escort", "escorts", "hentai", "milf", "porn", "porno", "pornos", "pornography", "xxx"),
    "gambling": ("casino", "casinos", "sportsbook", "sportsbooks"),
    "pharmacy": ("cialis", "kamagra", "levitra", "viagra"),
    "piracy": ("crackz", "keygen", "keygens", "serialz", "warez"),
    "abuse": ("botnet", "malware", "phishing", "spam", "spammer"),
}
# (weight, terms) by category: terms that block together.
SOFT = {
    "adult": (4, ("adult", "babes", "erotic", "erotik", "fetish", "naked", "nude", "nudes", "sex", "sexe", "sexo", "sexy")),
    "gambling": (4, (
        "apuestas", "baccarat", "bet", "bets", "betting", "bingo", "blackjack", "gambling", "jackpot", "poker", "roulette",
        "slots", "wager", "wetten",
    )),
    "pharmacy": (4, ("diet", "pharmacy", "pills", "rx", "steroids", "tramadol", "xanax")),
    "dating": (4, ("dating", "hookup", "hookups", "singles")),
    "credit": (4, ("forex", "kredit", "loans", "payday")),
    "piracy": (4, ("crack", "cracked", "nulled", "torrent", "torrents")),
    "advertising": (4, ("ads", "adserver", "banner", "banners", "doubleclick", "popup", "popunder")),
    "bait": (1, (
        "bonus", "buy", "cash", "cheap", "click", "coupon", "deal", "deals", "discount", "download", "easy", "farm", "free",
        "gratis", "hot", "instant", "loan", "money", "offer", "online", "prize", "promo", "rich", "track", "tracker", "win",
        "winner", "x",
    )),
}
STRICT_TERMS = tuple(t for terms in STRICT.values() for t in terms)
SOFT_TERMS = {t: weight for weight, terms in SOFT.values() for t in terms}
# The sum of weights of different soft terms that blocks; above any single weight.
SOFT_LIMIT = 5
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def parts(url: str | None) -> tuple[str, str]:
    """Host, lower-cased in ASCII, and path."""
    found = _URL.search(url or "")
    return (found[1].translate(_UPPER), found[2]) if found else ("", "")


class Rules:
    """``(verdict, "host/path")`` pairs, found by the host and its parent domains."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, verdict, rule))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[int, int, str, str] | None = None
        at = 0
        while at >= 0 and host:
            domain = host[at:]
            for start, verdict, rule in self.by_host.get(domain, ()):
                if path.startswith(start) and (best is None or (len(rule), len(domain)) > best[:2]):
                    best = (len(rule), len(domain), rule, verdict)
            at = host.find(".", at) + 1 or -1
        return best[2:] if best else (None, None)


class Terms:
    """Aho-Corasick over both vocabularies, with a check of the characters next to a hit."""

    def __init__(self, strict: Iterable[str], soft: Mapping[str, int]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for term, weight in soft.items():
            self.machine.add_word(term, (weight, term))
        for term in strict:
            self.machine.add_word(term, (0, term))
        self.empty = not len(self.machine)
        if not self.empty:
            self.machine.make_automaton()

    @staticmethod
    def _joins(c: str) -> bool:
        return "a" <= c <= "z" or "0" <= c <= "9"

    def hits(self, where: str) -> tuple[int, int, int]:
        """Different strict and soft terms that stand alone in ``where``, and the weight of the soft ones."""
        found: dict[str, int] = {}
        for end, (weight, term) in () if self.empty else self.machine.iter(where):
            start = end - len(term) + 1
            if (not start or not self._joins(where[start - 1])) and (
                end + 1 == len(where) or not self._joins(where[end + 1])
            ):
                found[term] = weight
        soft = [w for w in found.values() if w]
        return len(found) - len(soft), len(soft), sum(soft)


def judge_urls(
    df: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    strict: Iterable[str] = STRICT_TERMS,
    soft: Mapping[str, int] = SOFT_TERMS,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """(id, host, path, rule, verdict, strict_hits, soft_hits, soft_weight), one row per input row, without a shuffle.

    ``soft`` has the weights, of 1 or more, of the soft terms. ``rules`` and terms go to every task with the code: lists that a person or
    a feed maintains, of up to about a million entries.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        known, terms = Rules(rules), Terms(strict, soft)

        def work(given: dict[str, list]) -> dict[str, list]:
            rows = []
            for url in given["url"]:
                host, path = parts(url)
                rule, verdict = known.match(host, path)
                hard, mild, weight = terms.hits(host + path.translate(_UPPER))
                if verdict is None:
                    verdict = "block" if hard or (mild > 1 and weight >= soft_limit) else "allow"
                rows.append((host, path, rule, verdict, hard, mild, weight))
            names = ("host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight")
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return {"id": given["id"]} | dict(zip(names, map(list, columns), strict=True))

        return work

    schema = f"id {kind}, host string, path string, rule string, verdict string, "
    schema += "strict_hits long, soft_hits long, soft_weight long"
    return map_rows(df, {"id": F.col(f"`{id_col}`"), "url": F.col(f"`{url_col}`")}, make, schema)
