"""URL filter: a weighted vocabulary matched by an Aho-Corasick automaton, after host rules.

A term counts where no letter or digit touches it on either side. One strict term rejects a URL;
soft terms reject it from ``SOFT_LIMIT`` different ones on. Rules on host and path come first:
a rule fits its host and all subdomains of it where the path starts with the rule's path, and the
longest fitting rule decides alone.

A null URL, or one without ``://``, has an empty host and path: no rule fits, and its verdict is
that of the vocabulary on the whole string ("allow" for null). Repeated rows are judged one by one;
an empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from terralux.llm.common import small_batches

#: A term with weight STRICT rejects alone, others count as soft.
STRICT, SOFT = 2, 1
SOFT_LIMIT = 2
VOCABULARY: dict[str, int] = {
    **dict.fromkeys(
        "porn porno xxx hentai escort camgirls nudes casino slots viagra cialis cheap-pills payday-loan "
        "malware phishing warez keygen torrents spam-farm link-farm clickbait-farm".split(),
        STRICT,
    ),
    **dict.fromkeys(
        "adult sex hot dating bet betting poker jackpot bonus win winner free cheap pills pharmacy loan "
        "loans credit crypto spam farm promo deal deals discount click download crack hack cash".split(),
        SOFT,
    ),
}
#: (host, path, verdict)
RULES: list[tuple[str, str, str]] = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
RESULT = "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int"

_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = frozenset("0123456789abcdefghijklmnopqrstuvwxyz")


def split_url(url: str) -> tuple[str, str]:
    """Host and path of a URL; both empty without ``://``."""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end].translate(_ASCII_LOWER), rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host, rest[:end]


@lru_cache(maxsize=4)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for term in terms:
        automaton.add_word(term, term)
    automaton.make_automaton()
    return automaton


def found_terms(url: str, automaton: ahocorasick.Automaton) -> set[str]:
    """Different terms of the vocabulary in ``url`` that no letter or digit touches."""
    text = url.translate(_ASCII_LOWER)
    hits = set()
    for last, term in automaton.iter(text):
        first = last - len(term)
        if (first < 0 or text[first] not in _WORD) and (last + 1 == len(text) or text[last + 1] not in _WORD):
            hits.add(term)
    return hits


def fitting_rule(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str | None, str | None]:
    """The longest rule for this host and path, looked up by the host's suffixes; and its verdict."""
    suffix, best = host, (None, None)
    while suffix:
        for start, verdict in rules.get(suffix, ()):
            if path.startswith(start) and (best[0] is None or len(suffix + start) > len(best[0])):
                best = (suffix + start, verdict)
        suffix = suffix.partition(".")[2]
    return best


def judge_urls(
    pages: DataFrame,
    vocabulary: dict[str, int] = VOCABULARY,
    rules: list[tuple[str, str, str]] = RULES,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """One row per page: host, path, the rule that decided, verdict and the counts of terms."""
    small_batches(pages.sparkSession)
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(tuple(sorted(vocabulary)))
        for batch in batches:
            rows = []
            for page_id, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                url = url or ""
                host, path = split_url(url)
                terms = found_terms(url, automaton)
                strict = sum(vocabulary[t] >= STRICT for t in terms)
                soft = len(terms) - strict
                rule, verdict = fitting_rule(host, path, by_host)
                if rule is None:
                    verdict = "block" if strict or soft >= soft_limit else "allow"
                rows.append((page_id, host, path, rule, verdict, strict, soft))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), *[pa.string()] * 4, pa.int32(), pa.int32()]
            names = ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return pages.select("page_id", "url").mapInArrow(judge, RESULT)
