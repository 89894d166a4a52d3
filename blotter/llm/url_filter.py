"""Allow and block URLs by host and path rules, held in a trie.

The trie's upper part is keyed by host labels from the right (``com``, ``example``,
``www``), its lower part by path segments. One walk down both finds every rule that
fits a URL. The deepest host wins, then the longest path; of an allow and a block
entry for the very same place, block wins.

Defined cases: a null URL or one without ``://`` has an empty host and an empty path,
so no rule fits and it gets the default verdict; so does a URL whose path does not
start with ``/`` (``http://a.com?q``) under rules that ask for ``/``. Repeated rows are
judged alike and each is returned. URLs are read whole whatever their length. An empty table gives an empty result. Only the
identifier and the URL are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import staged

ALLOW, BLOCK = "allow", "block"

# Rules of one broadcast trie. A longer list is applied in blocks of this size, one
# pass each, so that no executor ever holds more than one block at a time.
TRIE_RULES = 1_000_000

_JUDGED = "host string, path string, rule string, verdict string, labels int"


@dataclass(frozen=True)
class Rule:
    """One entry of a list. It covers the host, its subdomains, and paths so starting."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


class UrlTrie:
    """Rules by reversed host label, then by path segment."""

    def __init__(self, rules: Sequence[Rule]):
        self.root: dict = {"labels": {}, "paths": None}
        for rule in rules:
            if rule.verdict not in (ALLOW, BLOCK) or not rule.host:
                raise ValueError(f"not a rule: {rule}")
            self._add(rule)

    def _add(self, rule: Rule) -> None:
        node = self.root
        for label in reversed(rule.host.split(".")):
            node = node["labels"].setdefault(label, {"labels": {}, "paths": None})
        if node["paths"] is None:
            node["paths"] = _path_node()
        node = node["paths"]
        for segment in path_segments(rule.path):
            if segment.endswith("/"):
                node = node["segments"].setdefault(segment, _path_node())
            else:
                _put(node["starts"], segment, rule)
                return
        _put(node, "rule", rule)

    def find(self, host: str, path: str) -> tuple[Rule | None, int]:
        """The rule that decides, and how many host labels it names."""
        node, best, depth, segments = self.root, None, 0, path_segments(path)
        for labels, label in enumerate(reversed(host.split(".")), 1):
            node = node["labels"].get(label)
            if node is None:
                break
            if node["paths"] is not None:
                found = _longest(node["paths"], segments)
                if found is not None:
                    best, depth = found, labels
        return best, depth


def path_segments(path: str) -> list[str]:
    """``/en/a`` is ``/``, ``en/``, ``a``: only the last may lack its slash."""
    return re.findall(r"[^/]*/|[^/]+", path)


def split_url(url: str | None) -> tuple[str, str]:
    """Host, with A-Z in lower case, and path."""
    start = -1 if url is None else url.find("://")
    if start < 0:
        return "", ""
    rest = url[start + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def judge_urls(
    df: DataFrame,
    rules: Sequence[Rule],
    id_column: str = "page_id",
    url_column: str = "url",
    default: str = ALLOW,
    trie_rules: int = TRIE_RULES,
) -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row, in one pass without a shuffle."""
    judged = df.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"))
    judged = judged.withColumn(
        "best", F.lit(None).cast("struct<host:string,path:string,rule:string,verdict:string,labels:int>")
    )
    blocks = [rules[i : i + trie_rules] for i in range(0, len(rules), trie_rules)] or [[]]
    for number, block in enumerate(blocks):
        if number:
            judged = staged(judged, "urls")
        judged = judged.withColumn("best", _judge(df, block)(F.col("url"), F.col("best")))
    return judged.select(
        F.col("id").alias(id_column),
        "best.host",
        "best.path",
        "best.rule",
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def _judge(df: DataFrame, rules: Sequence[Rule]):
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf(_JUDGED)
    def judge(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for urls, before in batches:
            rows = [
                _better(trie.value, split_url(url), *earlier)
                for url, earlier in zip(
                    urls, before[["rule", "verdict", "labels"]].itertuples(index=False)
                )
            ]
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "labels"])

    return judge


def _better(trie: UrlTrie, place, rule, verdict, labels):
    """What this block's trie finds, unless an earlier block found a longer rule."""
    host, path = place
    found, depth = trie.find(host, path)
    if found is not None:
        new = (depth, len(found.text), found.verdict == BLOCK)
        if not isinstance(rule, str) or new > (labels, len(rule), verdict == BLOCK):
            rule, verdict, labels = found.text, found.verdict, depth
    if not isinstance(rule, str):
        return host, path, None, None, None
    return host, path, rule, verdict, int(labels)


def _path_node() -> dict:
    return {"segments": {}, "starts": {}, "rule": None}


def _put(place: dict, key: str, rule: Rule) -> None:
    held = place.get(key)
    if held is None or rule.verdict == BLOCK:
        place[key] = rule


def _longest(node: dict, segments: list[str]) -> Rule | None:
    best = node["rule"]
    for segment in segments:
        starts = [s for s in node["starts"] if segment.startswith(s)]
        if starts:
            best = node["starts"][max(starts, key=len)]
        node = node["segments"].get(segment)
        if node is None:
            break
        best = node["rule"] or best
    return best
