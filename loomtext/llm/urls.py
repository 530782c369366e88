"""URL allow and block lists: a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most nodes (labels and segments) of a trie, which is broadcast; a longer list is refused. A node takes some
#: 500 bytes with its rule, so a trie 130 MB at most, in the driver and in each worker.
MAX_NODES = 1 << 18


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path


class RuleTrie:
    """Host nodes by label from the right; below each, path nodes by segment.

    A rule's path is a plain prefix, so its last segment may match the beginning of a longer one; such
    ends are kept beside the children of their node by the unfinished segment.
    """

    def __init__(self, rules: Iterable[UrlRule]):
        self.root: dict = {}
        nodes = 0
        for rule in rules:
            nodes += rule.host.count(".") + rule.path.count("/") + 2
            if nodes > MAX_NODES:
                raise ValueError(f"rules need more than {MAX_NODES} nodes")
            node = self.root
            for label in reversed(rule.host.split(".")) if rule.host else ():
                node = node.setdefault("hosts", {}).setdefault(label, {})
            path = node.setdefault("paths", {})
            *whole, last = rule.path.split("/")
            for segment in whole:
                path = path.setdefault("children", {}).setdefault(segment, {})
            ends = path.setdefault("ends", {})
            path["longest"] = max(path.get("longest", 0), len(last))
            if (old := ends.get(last)) is None or (rule.verdict, old.verdict) == ("block", "allow"):
                ends[last] = rule

    @staticmethod
    def _longest(path: dict, segments: list[str]) -> UrlRule | None:
        best = None
        for segment in segments:
            for k in range(min(len(segment), path.get("longest", -1)), -1, -1):
                if segment[:k] in path["ends"]:
                    best = path["ends"][segment[:k]]
                    break
            path = path.get("children", {}).get(segment)
            if path is None:
                break
        return best

    def match(self, host: str, path: str) -> UrlRule | None:
        """The rule with most host labels, then the longest path; of equals, block."""
        segments, node = path.split("/"), self.root
        best = self._longest(node["paths"], segments) if "paths" in node else None
        for label in reversed(host.split(".")):
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            if "paths" in node:
                best = self._longest(node["paths"], segments) or best
        return best


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return host, path


def filter_urls(pages: DataFrame, rules: Iterable[UrlRule], url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """``keep``, host, path, rule (its host and path, else null) and verdict, one row for each row.

    ``default`` where no rule fits. The trie is sent to each task once; its size is checked.
    """
    shared = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.arrow_udf("struct<rule string, verdict string>")
    def verdicts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        trie = shared.value
        kind = pa.struct([("rule", pa.string()), ("verdict", pa.string())])
        for hosts, paths in batches:
            found = [trie.match(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
            yield pa.array([{"rule": r.text, "verdict": r.verdict} if r else {"rule": None, "verdict": default} for r in found], kind)

    host, path = url_parts(F.col(url))
    return (
        pages.select(*keep, host.alias("host"), path.alias("path"))
        .withColumn("__v", verdicts("host", "path"))
        .select(*keep, "host", "path", F.col("__v.rule").alias("rule"), F.col("__v.verdict").alias("verdict"))
    )
