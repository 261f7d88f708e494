"""Operator 11: URL filter by a weighted vocabulary and host rules.

The url is folded (A-Z to lower case, every run of other characters than letters and digits to one "-") and an
Aho-Corasick automaton finds all terms of the vocabulary in one pass; a find counts if it begins and ends at a "-" or at
an end of the url. One strict term or `min_soft` different soft terms reject the url. Rules of (verdict, host, path) go
first: a rule fits its host and all subdomains where the url's path begins with its own, and the longest fitting rule
decides.

host: what follows the first "://" up to "/", "?", "#" or the end, A-Z in lower case; path: what follows it up to "?",
"#" or the end. Rules and terms are settings: every task holds them, and a url asks only for its own host's suffixes.

Defined cases: null, empty and "://"-less urls have an empty host and path (terms are still looked for) and null urls
no hits; repeated rows are judged each; of equally long rules the first given wins; an empty table gives no rows; other
columns are kept, and one that is named like a new one gives way to it. A very long url costs one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: (term, weight); a phrase's parts are divided by "-", which stands for any run of other characters.
STRICT = [
    ("porn", 10), ("porno", 10), ("pornos", 10), ("xxx", 10), ("xvideos", 10), ("hentai", 10), ("milf", 10), ("camgirls", 10), ("blowjob", 10),
    ("live-sex", 10), ("sex-cam", 10), ("sex-chat", 10), ("sex-tube", 10), ("online-casino", 10), ("buy-viagra", 10), ("escort-service", 10),
]
SOFT = [
    ("adult", 2), ("sex", 3), ("sexy", 2), ("nude", 3), ("erotic", 3), ("erotik", 3), ("erotica", 3), ("dating", 1), ("webcam", 1), ("cams", 2),
    ("escort", 2), ("fetish", 3), ("lingerie", 1), ("casino", 3), ("poker", 2), ("slots", 2), ("bet", 1), ("betting", 2), ("jackpot", 2),
    ("viagra", 3), ("cialis", 3), ("pharmacy", 1), ("pills", 1), ("payday", 2), ("loan", 1), ("crack", 1), ("keygen", 3), ("warez", 3),
    ("torrent", 2), ("free", 1), ("cheap", 1), ("videos", 1), ("apuestas", 2), ("desnuda", 3), ("gratuit", 1), ("kostenlos", 1), ("wetten", 2),
]
MIN_SOFT = 2

Rule = tuple[str, str, str]

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_OTHER, _HOST, _PATH = re.compile(r"[\W_]+"), re.compile(r"[^/?#]*"), re.compile(r"[^?#]*")
NEW = [
    ("host", StringType()), ("path", StringType()), ("rule", StringType()), ("verdict", StringType()),
    ("strict_hits", LongType()), ("soft_hits", LongType()), ("soft_terms", LongType()), ("weight", LongType()),
]


def folded(text: str) -> str:
    return _OTHER.sub("-", text.translate(_LOWER))


def host_and_path(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = _HOST.match(rest).group()
    return host.translate(_LOWER), _PATH.match(rest, len(host)).group()


class Vocabulary:
    """Automaton of the terms; counts(url) gives strict hits, soft hits, different soft terms and the weight of all hits."""

    def __init__(self, strict: Iterable[tuple[str, int]], soft: Iterable[tuple[str, int]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for hard, terms in ((False, soft), (True, strict)):  # a term in both lists is strict
            for term, weight in terms:
                term = folded(term).strip("-")
                self.automaton.add_word(term, (hard, term, weight))
        self.automaton.make_automaton()

    def counts(self, url: str | None) -> tuple[int, int, int, int]:
        text = folded(url or "")
        hard_hits = soft_hits = total = 0
        kinds = set()
        for end, (hard, term, weight) in self.automaton.iter(text) if len(self.automaton) else ():
            begin = end - len(term)
            if (begin >= 0 and text[begin] != "-") or text[end + 1 : end + 2] not in ("", "-"):
                continue
            total += weight
            if hard:
                hard_hits += 1
            else:
                soft_hits += 1
                kinds.add(term)
        return hard_hits, soft_hits, len(kinds), total


class Rules:
    """Rules by host, the longest path first."""

    def __init__(self, rules: Iterable[Rule]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"a rule allows or blocks: {verdict}")
            self.by_host.setdefault(host.translate(_LOWER), []).append((path, host + path, verdict))
        for own in self.by_host.values():
            own.sort(key=lambda r: -len(r[0]))

    def best(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        found, at = None, 0
        while self.by_host:
            for own, name, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(own):
                    if found is None or len(name) > len(found[0]):
                        found = name, verdict
                    break
            dot = host.find(".", at)
            if dot < 0:
                return found
            at = dot + 1
        return found


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule] = (), strict: Sequence[tuple[str, int]] = STRICT, soft: Sequence[tuple[str, int]] = SOFT,
    min_soft: int = MIN_SOFT, url: str = "url",
) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block), strict_hits, soft_hits, soft_terms (different ones), weight."""
    names = {n for n, _ in NEW}
    kept = [f for f in pages.schema.fields if f.name.lower() not in names]
    schema = StructType([*kept, *[StructField(n, kind) for n, kind in NEW]])
    rules, strict, soft = list(rules), list(strict), list(soft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, own = Vocabulary(strict, soft), Rules(rules)
        for batch in batches:
            rows = []
            for value in batch.column(url).to_pylist():
                host, path = host_and_path(value)
                counts = vocabulary.counts(value)
                rule, verdict = own.best(host, path) or (None, "block" if counts[0] or counts[2] >= min_soft else "allow")
                rows.append((host, path, rule, verdict, *counts))
            new = zip(*rows) if rows else [[]] * len(NEW)
            columns = [pa.array(list(v), pa.string() if isinstance(kind, StringType) else pa.int64()) for (_, kind), v in zip(NEW, new)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *columns], names=schema.names)

    return pages.mapInArrow(run, schema)
