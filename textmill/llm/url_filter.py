"""URL filter: a trie over reversed host labels and path segments decides between allow and block entries.

A rule is (verdict, host, path). It fits its host and every subdomain of it when the url's path starts with the
rule's path. The deepest host wins, then the longest path; of two equal rules, block wins.

Defined cases: a null url, or one without "://", has an empty host and an empty path and fits no rule unless a rule
has an empty host and path; an empty table gives an empty result; repeated rows are judged alike. Only the id and url
columns are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The trie is broadcast to every executor, so what it is built from is bounded; more rules than this is an error.
MAX_RULE_BYTES = 64 << 20

JUDGED = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]
)

_URL = re.compile(r"://([^/?#]*)([^?#]*)")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first "://", A-Z lower-cased) and path of a url."""
    found = _URL.search(url) if url is not None else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


class UrlTrie:
    """Host labels from the last to the first, then path segments; the last, unfinished segment is a tail.

    Nodes are numbers and edges rows of a dict, so rules of any depth are sent and searched without recursion.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        #: (node, label or segment) -> node; a None leads from a host to the paths below it
        self.edges: dict[tuple[int, str | None], int] = {}
        #: (node, tail) -> (rule, verdict)
        self.tails: dict[tuple[int, str], tuple[str, str]] = {}
        #: node -> lengths of its tails, the longest first
        self.lengths: dict[int, list[int]] = {}
        size = 0
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict must be allow or block: {verdict!r}")
            size += len(host) + len(path)
            if size > MAX_RULE_BYTES:
                raise ValueError(f"rules hold more than {MAX_RULE_BYTES} characters")
            *whole, tail = path.split("/")
            node = 0
            for step in (*(reversed(host.split(".")) if host else ()), None, *whole):
                node = self.edges.setdefault((node, step), len(self.edges) + 1)
            if self.tails.get((node, tail), ("", "allow"))[1] == "allow":
                self.tails[node, tail] = (host + path, verdict)
            self.lengths[node] = sorted({len(tail), *self.lengths.get(node, ())}, reverse=True)

    def _longest_path(self, node: int, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            for n in self.lengths.get(node, ()):
                if n <= len(segment) and (hit := self.tails.get((node, segment[:n]))):
                    best = hit
                    break
            node = self.edges.get((node, segment))
            if node is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits, or None."""
        node, found = 0, []
        for label in (*(reversed(host.split(".")) if host else ()), ""):
            if (paths := self.edges.get((node, None))) is not None:
                found.append(paths)
            node = self.edges.get((node, label))
            if node is None:
                break
        segments = path.split("/")
        for paths in reversed(found):
            if hit := self._longest_path(paths, segments):
                return hit
        return None


def judge(url: Column, rules: Iterable[tuple[str, str, str]], default: str = "allow") -> Column:
    """Struct of host, path, rule (null if none fits) and verdict (`default` if none fits) for a url column."""
    shared = SparkSession.active().sparkContext.broadcast(UrlTrie(rules))

    @F.arrow_udf(JUDGED)
    def judged(urls: pa.Array) -> pa.Array:
        trie, rows = shared.value, []
        for u in urls.to_pylist():
            host, path = split_url(u)
            rule, verdict = trie.match(host, path) or (None, default)
            rows.append((host, path, rule, verdict))
        columns = list(zip(*rows)) or [()] * len(JUDGED)
        return pa.StructArray.from_arrays(
            [pa.array(c, pa.string()) for c in columns], names=JUDGED.names
        )

    return judged(url)


def filter_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]],
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row for each page: its id, host, path, deciding rule and verdict. Narrow: nothing is shuffled."""
    return (
        pages.select(F.col(id_col), judge(F.col(url_col), rules, default).alias("judged"))
        .select(id_col, "judged.*")
    )
