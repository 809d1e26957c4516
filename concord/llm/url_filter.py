"""Allow and block lists for urls: a trie over reversed host labels and path segments.

The trie is broadcast: it is built from a rule table given by the caller, whose size is checked
against ``MAX_RULES``; a larger list must be passed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 2_000_000
DEFAULT = "allow"

Rule = tuple[str, str, str]  # verdict, host, path


def lower_ascii(s: str) -> str:
    return s.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as they stand in the url; both empty without ``://`` or url."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for i in (rest.find("?"), rest.find("#")) if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    cut = rest.find("/")
    return (lower_ascii(rest), "") if cut < 0 else (lower_ascii(rest[:cut]), rest[cut:])


class UrlTrie:
    """Nodes by reversed host label; at a node, a second trie by path segment.

    A rule's last path segment may be a prefix of the url's segment ("/en/7" fits "/en/78"), so path
    nodes keep such open ends by their text. The longest match wins: more host labels first, then the
    longer path. Of equal rules the first given stays.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {"kids": {}, "paths": None}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(lower_ascii(host).split(".")):
                node = node["kids"].setdefault(label, {"kids": {}, "paths": None})
            if node["paths"] is None:
                node["paths"] = {"kids": {}, "ends": {}}
            at = node["paths"]
            *whole, last = path.split("/")
            for segment in whole:
                at = at["kids"].setdefault(segment, {"kids": {}, "ends": {}})
            at["ends"].setdefault(last, (host + path, verdict))

    @staticmethod
    def _on_path(paths: dict, path: str) -> tuple[str, str] | None:
        best, at = None, paths
        for segment in path.split("/"):
            ends = at["ends"]
            if ends:
                for n in range(len(segment), -1, -1):
                    if segment[:n] in ends:
                        best = ends[segment[:n]]
                        break
            at = at["kids"].get(segment)
            if at is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, node = None, self.root
        for label in reversed(host.split(".")) if host else ():
            node = node["kids"].get(label)
            if node is None:
                break
            if node["paths"] is not None and (found := self._on_path(node["paths"], path)):
                best = found
        return best or (None, None)


def filter_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """key, host, path, rule and verdict of each row.

    A null url has empty host and path, no rule and the default verdict; repeated rows and null keys
    stay as they are; other columns are not read; an empty table gives an empty result.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the broadcast trie takes {MAX_RULES} at most")
    spark = pages.sparkSession
    trie = spark.sparkContext.broadcast(UrlTrie(rules))
    kind = pages.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie.value
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            found = [t.find(*p) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([x[i] for x in parts], pa.string()) for i in (0, 1)), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] or default for f in found], pa.string())],
                names=[key, "host", "path", "rule", "verdict"],
            )

    return pages.select(F.col(key), F.col(url).cast("string").alias("url")).mapInArrow(judge, f"{key} {kind}, host string, path string, rule string, verdict string")
