"""URL filter: host and path rules first, then a weighted vocabulary.

An Aho-Corasick automaton counts strict and soft terms in the URL, as written and as it reads with percent escapes
and punycode host labels decoded once. A term counts where neither neighbour is a letter or digit of any script;
a URL goes on one strict term, or on several distinct soft ones whose weights reach a floor.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator, Mapping
from urllib.parse import unquote

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms of which one is enough.
STRICT_TERMS = ("casino", "porn", "xxx", "viagra", "spam", "adult", "gambling", "warez", "phishing", "malware")
#: Terms of which two different ones are needed; each weighs 1 unless a vocabulary says otherwise.
SOFT_TERMS = ("cheap", "pills", "free", "bets", "ads", "track", "win", "bonus", "loans", "poker", "escort", "dating", "crack", "torrent")
#: Verdict, rule: a host with all its subdomains, and the start of the path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    found = _URL.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def _unicode_label(label: str) -> str:
    """A host's label as it reads: punycode decoded, the label itself where that fails."""
    if label[:4].lower() != "xn--":
        return label
    try:
        return label[4:].encode("ascii").decode("punycode")
    except (UnicodeError, ValueError, OverflowError):
        return label


def readable(url: str | None) -> str:
    """The URL as terms are sought in it: escapes decoded as UTF-8 once, punycode labels of the host too, lower-cased.

    Bytes that aren't UTF-8 become U+FFFD, which is no letter; an escape of another shape stays as it is.
    """
    text = url or ""
    if "xn--" in text.lower() and (found := _URL.search(text)):
        start, end = found.span(1)
        text = text[:start] + ".".join(map(_unicode_label, text[start:end].split("."))) + text[end:]
    return (unquote(text) if "%" in text else text).lower()


def vocabulary(table: DataFrame, most: int = 1_000_000) -> tuple[tuple[str, ...], dict[str, float]]:
    """Strict terms, and soft ones with their weights, of a table ``term, kind (strict or soft), weight``.

    A term that stands twice is strict if it is once, and has the largest of its weights, 1 where all are null; null, empty and
    other kinds' rows are left out. The automaton travels to every task, so a table of more than ``most`` terms is refused.
    """
    term = F.lower(F.trim("term"))
    rows = table.where(F.col("kind").isin("strict", "soft") & (term != "")).groupBy(term.alias("term")).agg(F.min(F.col("kind") != "strict").alias("soft"), F.max("weight").alias("weight"))
    found = rows.orderBy("term").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a vocabulary holds at most {most} terms")
    return tuple(r.term for r in found if not r.soft), {r.term: 1.0 if r.weight is None else float(r.weight) for r in found if r.soft}


class UrlJudge:
    """Rules and vocabulary as lookups."""

    def __init__(self, rules: Iterable[tuple[str, str]], strict: Iterable[str], soft: Iterable[str] | Mapping[str, float], soft_needed: int, weight_needed: float = 0.0):
        self.soft_needed, self.weight_needed = soft_needed, weight_needed
        self.weights = dict(soft) if isinstance(soft, Mapping) else dict.fromkeys(soft, 1.0)
        self.rules: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, _, path = rule.partition("/")
            self.rules.setdefault(host, []).append((rule, f"/{path}", verdict))
        self.terms = ahocorasick.Automaton()
        for term in self.weights:
            self.terms.add_word(term, (term, False))
        for term in strict:
            self.terms.add_word(term, (term, True))
        self.terms.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, and its verdict; of equal ones a block."""
        fits, at = [], host
        while True:
            fits += [(len(rule), verdict == "block", rule, verdict) for rule, start, verdict in self.rules.get(at, ()) if path.startswith(start)]
            _, dot, at = at.partition(".")
            if not dot:
                return max(fits)[2:] if fits else None

    def counts(self, url: str | None) -> tuple[int, set[str]]:
        """Occurrences of strict terms, as written or as it reads, whichever are more, and the distinct soft ones of both."""
        strict, soft = 0, set()
        for text in {(url or "").lower(), readable(url)} if len(self.terms) else ():
            hits = 0
            for end, (term, is_strict) in self.terms.iter(text):
                if not text[max(end - len(term), 0) : end - len(term) + 1].isalnum() and not text[end + 1 : end + 2].isalnum():
                    hits += is_strict
                    soft |= set() if is_strict else {term}
            strict = max(strict, hits)
        return strict, soft

    def verdict(self, url: str | None) -> tuple:
        host, path = host_and_path(url)
        rule, (strict, soft) = self.rule(host, path), self.counts(url)
        weight = sum(self.weights[t] for t in sorted(soft))
        own = "block" if strict or (len(soft) >= self.soft_needed and weight >= self.weight_needed) else "allow"
        return host, path, rule and rule[0], rule[1] if rule else own, strict, len(soft), weight


def judge_urls(pages: DataFrame, *, url_col: str = "url", rules: Iterable[tuple[str, str]] = RULES, strict: Iterable[str] = STRICT_TERMS, soft: Iterable[str] | Mapping[str, float] = SOFT_TERMS, soft_needed: int = 2, weight_needed: float = 0.0) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, n_strict, n_soft, soft_weight`` (columns of these names are replaced).

    A URL that meets no rule is blocked by one strict term, or by ``soft_needed`` distinct soft ones that together weigh
    ``weight_needed`` (``soft`` maps terms to weights, or lists terms that weigh 1 each; ``vocabulary`` reads both from a table).
    Rules and terms are parameters of bounded size and travel with the function. A URL that is null, empty or
    without ``://`` has an empty host and path, meets no rule, and is judged by its terms; null has none and is
    allowed. Every row is judged for itself, repeated ones too; an empty table gives an empty one.
    """
    judge_of = {"rules": tuple(rules), "strict": tuple(strict), "soft": dict(soft) if isinstance(soft, Mapping) else tuple(soft), "soft_needed": soft_needed, "weight_needed": weight_needed}

    @F.pandas_udf("host string, path string, rule string, verdict string, n_strict int, n_soft int, soft_weight double")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = UrlJudge(**judge_of)
        for urls in parts:
            yield pd.DataFrame([judge.verdict(u) for u in urls], columns=list(new))

    new = ("host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight")
    kept: list[Column] = [F.col(c) for c in pages.columns if c not in (*new, "__judged")]
    return pages.select(*kept, judged(url_col).alias("__judged")).select(*kept, *(F.col(f"__judged.{c}") for c in new))
