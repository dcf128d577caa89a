"""URL filter: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

import string
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from types import MappingProxyType

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCKED_WEIGHT = 3  # of distinct terms: one strict term, or several soft ones

#: Words that alone are enough.
STRICT_TERMS = (
    "porn", "porno", "pornos", "pornhub", "xxx", "xvideos", "xnxx", "redtube", "youporn", "hentai", "milf", "milfs", "sexcam", "sexcams", "camgirl", "camgirls",
    "blowjob", "creampie", "gangbang", "bukkake", "incest", "hardcore", "softcore", "malware", "warez", "phishing", "ransomware", "cialis", "viagra",
)
#: Words that say much; two of them, or one with a weak word, are enough.
SOFT_TERMS = (
    "adult", "sex", "sexy", "nude", "nudes", "naked", "erotic", "erotica", "escort", "escorts", "fetish", "webcam", "casino", "casinos", "poker", "betting", "bets", "bet",
    "gamble", "gambling", "slots", "jackpot", "lottery", "roulette", "pills", "pharmacy", "crack", "cracked", "keygen", "serials", "torrent", "torrents", "hack", "hacks",
    "loan", "loans", "payday", "dating", "hookup", "spam", "ads", "popups", "replica", "counterfeit",
)
#: Words that only count beside others.
WEAK_TERMS = ("free", "cheap", "win", "bonus", "cash", "hot", "girls", "teen", "teens", "live", "cam", "cams", "chat", "singles", "track", "click", "farm", "download", "discount", "rx")
WEIGHTS = {**dict.fromkeys(WEAK_TERMS, 1), **dict.fromkeys(SOFT_TERMS, 2), **dict.fromkeys(STRICT_TERMS, BLOCKED_WEIGHT)}
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_INNER = frozenset(string.ascii_lowercase + string.digits)  # a term counts only with none of these on either side


@dataclass(frozen=True)
class Rule:
    """verdict for a host, its subdomains, and all paths that begin with path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlPolicy:
    rules: tuple[Rule, ...]
    weights: Mapping[str, int] = MappingProxyType(WEIGHTS)
    blocked_weight: int = BLOCKED_WEIGHT


def longest_rule(by_host: dict[str, list[Rule]], host: str, path: str) -> Rule | None:
    """The longest fitting rule: by its whole length, then by host and path for a defined result."""
    found, at = [], 0
    while True:
        found += [r for r in by_host.get(host[at:], ()) if path.startswith(r.path)]
        dot = host.find(".", at)
        if dot < 0:
            return max(found, key=lambda r: (len(r.name), r.host, r.path), default=None)
        at = dot + 1


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z in lower case, and path; both empty without "://"."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host_end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path_end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:host_end])
    return host, rest[host_end : max(host_end, path_end)]


def automaton(policy: UrlPolicy) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in policy.weights.items():
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def vocabulary_verdict(url: str | None, terms: ahocorasick.Automaton, blocked_weight: int) -> tuple[str, int, int, int]:
    """Verdict, distinct strict terms, other distinct terms, weight of all of them.

    A-Z count as lower case. A term counts only where no ASCII letter or digit stands on either side.
    """
    text = (url or "").translate(_LOWER)
    hits = {}
    for last, (term, weight) in terms.iter(text):
        first = last - len(term) + 1
        if (first == 0 or text[first - 1] not in _INNER) and (last + 1 == len(text) or text[last + 1] not in _INNER):
            hits[term] = weight
    total, strict = sum(hits.values()), sum(w >= blocked_weight for w in hits.values())
    return "block" if total >= blocked_weight else "allow", strict, len(hits) - strict, total


def judge_urls(pages: DataFrame, policy: UrlPolicy, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Each row with host, path, the rule that decided (null: none) and the verdict.

    No shuffle, and only the two columns are read. A null or malformed url has empty host and path, no rule, and the
    vocabulary's verdict on what text there is (allow for null). Repeated rows stay; an empty table gives no rows.
    """
    by_host: dict[str, list[Rule]] = {}
    for r in policy.rules:
        by_host.setdefault(r.host, []).append(r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = automaton(policy)
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = longest_rule(by_host, host, path)
                verdict, *figures = vocabulary_verdict(url, terms, policy.blocked_weight)
                rows.append((host, path, rule and rule.name, rule.verdict if rule else verdict, *figures))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string()] * 4 + [pa.int32()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["page_id", "host", "path", "rule", "verdict", "strict_terms", "soft_terms", "weight"])

    kind = dict(pages.dtypes)[id_col]
    return pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url")).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, strict_terms int, soft_terms int, weight int")
