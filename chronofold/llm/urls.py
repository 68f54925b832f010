"""URL filters: many pattern rules, of which each URL meets only a few.

A rule is a pattern with a verdict.  ``||host/path`` fits a host, all of its
subdomains, and the paths that begin with its own.  Any other pattern is looked
for in the lower-cased URL: ``*`` stands for any text, ``+`` for any text without
a slash, question mark or number sign, ``^`` for the edge of a token, ``|`` at
either end for the end of the URL.  Tokens are runs of the letters a to z and
digits.

A rule can only fit URLs that hold all tokens which its pattern spells out in
full.  It is listed under the one of them that the fewest URLs have; the tokens
of a URL fetch the rules listed under them, and only these are tried as regular
expressions.  Rules that spell out no token are tried on every URL.
"""

from __future__ import annotations

import re
from collections import defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
_TOKENS = re.compile(TOKEN)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(_UPPER, _LOWER)
#: What the signs of a pattern stand for.
SIGNS = {"*": ".*", "+": "[^/?#]*", "^": "(?:(?<![a-z0-9])(?=[a-z0-9])|(?<=[a-z0-9])(?![a-z0-9]))"}


class Rule(NamedTuple):
    """A pattern and whether it blocks."""

    pattern: str
    block: bool

    @property
    def on_host(self) -> bool:
        return self.pattern.startswith("||")

    @property
    def name(self) -> str:
        return self.pattern.removeprefix("||")

    @property
    def verdict(self) -> str:
        return "block" if self.block else "allow"

    def regex(self) -> re.Pattern:
        if self.on_host:
            return re.compile(r"\A(?:[^/]*[.])?" + re.escape(self.name) + ("" if "/" in self.name else r"(?=/|\Z)"), re.DOTALL)
        inner = "".join(SIGNS.get(c) or re.escape(c) for c in self.pattern.strip("|"))
        return re.compile(r"\A" * self.pattern.startswith("|") + inner + r"\Z" * self.pattern.endswith("|"), re.DOTALL)

    def tokens(self) -> set[str]:
        """Tokens that every URL which the rule fits has as a whole."""
        if self.on_host:  # the host begins at a dot or at its start; the path may go on
            text = "|" + self.name.translate(_TO_LOWER)
        else:
            text = self.pattern
        out = set()
        for m in _TOKENS.finditer(text):
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if before not in ("", "*", "+") and after not in ("", "*", "+"):
                out.add(m[0])
        return out


#: The rules that come first, as given.
BASE = (Rule("||net/", True), Rule("||example.net/en/", False), Rule("||example.com/de/", True), Rule("||org/fr/", False))
#: Names that hosts of advertising, gambling, junk and adult pages carry.
NAMES = ("casino", "poker", "bets", "betting", "jackpot", "lottery", "spam", "ads", "adserver", "adtrack", "pills", "viagra", "cialis", "adult", "porn", "xxx", "sex", "escort", "warez", "crack", "torrent", "phish", "malware")
#: Patterns for the URLs that no first rule fits: such a name as a token of the host, and pages that only count clicks.
PATTERNS = (
    *(Rule(f"://+^{name}^", True) for name in NAMES),
    Rule("^doubleclick^", True), Rule("/ads/", True), Rule("/banner/", True), Rule("^safe^-^search^", False),
)


def split_url(url):
    """Host and path as columns: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; then up to ``?``, ``#`` or the end.  Both are empty where there is no ``://``."""
    rest = F.when(url.contains("://"), F.substring_index(F.concat(F.lit("x"), url), "://", 1))
    after = F.when(rest.isNotNull(), url.substr(F.length(rest) + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(after, "^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, _UPPER, _LOWER), path


def token_counts(pages: DataFrame, wanted: set[str], url_column: str = "url") -> dict[str, int]:
    """How many rows have each of the wanted tokens; at most one number for each token of the rules comes to the driver."""
    lowered = F.translate(F.col(url_column), _UPPER, _LOWER)
    tokens = F.array_distinct(F.regexp_extract_all(lowered, F.lit(TOKEN), F.lit(0)))
    kept = F.array_intersect(tokens, F.array(*(F.lit(t) for t in sorted(wanted)))) if wanted else F.array().cast("array<string>")
    return {t: n for t, n in pages.select(F.explode(kept).alias("t")).groupBy("t").count().collect()}


def index_rules(rules, counts: dict[str, int]) -> dict[str, list[int]]:
    """Places of the rules under their rarest tokens; those without one are under the empty token."""
    out = defaultdict(list)
    for i, rule in enumerate(rules):
        out[min(rule.tokens(), key=lambda t: (counts.get(t, 0), -len(t), t), default="")].append(i)
    return dict(out)


def _judge(rules, first: int, index: dict[str, list[int]]):
    """A function on Arrow batches; the first ``first`` rules come before the others."""
    patterns = [r.regex() for r in rules]
    size = [len(r.name) for r in rules]

    def best(fits: list[int]) -> int | None:
        """The longest; of equally long ones one that blocks, then the first listed."""
        return max(fits, key=lambda i: (size[i], rules[i].block, -i), default=None)

    def run(batches):
        for batch in batches:
            held: tuple[list, ...] = ([], [], [], [])
            for url, host, path in zip(*(batch.column(c).to_pylist() for c in ("__url", "host", "path")), strict=True):
                place, lowered = host + path, (url or "").translate(_TO_LOWER)
                tried = [i for t in {"", *_TOKENS.findall(lowered)} for i in index.get(t, ())]
                fits = [i for i in tried if patterns[i].search(place if rules[i].on_host else lowered)]
                ruled, told = best([i for i in fits if i < first]), best([i for i in fits if i >= first])
                held[0].append(None if ruled is None else rules[ruled].name)
                held[1].append(None if told is None else rules[told].name)
                held[2].append("allow" if ruled is None and told is None else rules[told if ruled is None else ruled].verdict)
                held[3].append(len(tried))
            kept = [c for c in batch.schema.names if c != "__url"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, k) for c, k in zip(held, (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True))], [*kept, "rule", "pattern", "verdict", "n_tried"])

    return run


def judge(pages: DataFrame, first=BASE, patterns=PATTERNS, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Verdict of each row's URL: the id, host, path, rule, pattern, verdict, and how many rules were tried.

    Of the rules ``first`` the longest that fits decides; where none fits, the
    longest of ``patterns``; where none of these does either, the URL is allowed.
    Equally long ones: one that blocks, then the one listed first.  A null URL,
    or one without ``://``, has an empty host and path.  Each row is judged for
    itself, so null and repeated ids do no harm, and other columns are not read.
    The number of rules must fit in a task's memory; their tokens are counted
    over all rows.  An empty table gives no rows.
    """
    rules = [*first, *patterns]
    index = index_rules(rules, token_counts(pages, set().union(*(r.tokens() for r in rules)), url_column))
    host, path = split_url(F.col(url_column))
    kind = pages.schema[id_column].dataType.simpleString()
    rows = pages.select(F.col(id_column), host.alias("host"), path.alias("path"), F.col(url_column).alias("__url"))
    return rows.mapInArrow(_judge(rules, len(list(first)), index), f"`{id_column}` {kind}, host string, path string, rule string, pattern string, verdict string, n_tried int")
