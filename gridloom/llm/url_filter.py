"""URL filters over a sorted digest array.

The entries of a list (rules and blocked hosts) are kept as a sorted array of 64-bit XXH64 keys beside the full
strings. Workers memory-map both files, so a list of any size costs no heap and is shared by the processes of a
machine; a batch of urls is probed by one vectorised binary search, and a key that is found counts only if the stored
string is equal.

A rule is a host and the beginning of a path, with a verdict. It fits its host and all subdomains if the url's path
begins with the rule's; the longest rule wins, and of two as long the one with the longer host. Where no rule fits,
the url is blocked if its host or a parent domain is in the block list, and else allowed.

Only page_id and url are read; there is no shuffle. The files go to the executors by ``addFile``.

Defined results: host and path are empty for a null url or one without ``://`` (verdict allow, no rule); repeated
rows are judged each; a null page_id is kept; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

_CAPITALS = {c: c + 32 for c in range(65, 91)}
_HOST_END = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) as the rules see them."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    m = _HOST_END.search(rest)
    end = m.start() if m else len(rest)
    m = _PATH_END.search(rest, end)
    return rest[:end].translate(_CAPITALS), rest[end : m.start() if m else len(rest)]


def _digest(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class DigestArray:
    """Distinct strings by sorted digest: files ``.keys`` (uint64), ``.ends`` (int64) and ``.text`` (UTF-8)."""

    def __init__(self, base: str) -> None:
        self.keys = self._map(base + ".keys", np.uint64)
        self.ends = self._map(base + ".ends", np.int64)
        self.text = self._map(base + ".text", np.uint8)

    @staticmethod
    def _map(path: str, kind: type) -> np.ndarray:
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)

    @staticmethod
    def write(entries: Iterable[str], base: str) -> list[str]:
        """Writes the files; returns the entries in their order."""
        found = sorted(set(entries), key=lambda e: (_digest(e), e))
        data = [e.encode("utf-8", "surrogatepass") for e in found]
        np.array([_digest(e) for e in found], np.uint64).tofile(base + ".keys")
        np.cumsum([len(d) for d in data], dtype=np.int64).tofile(base + ".ends")
        with open(base + ".text", "wb") as file:
            file.write(b"".join(data))
        return found

    def entry(self, i: int) -> str:
        return bytes(self.text[self.ends[i - 1] if i else 0 : self.ends[i]]).decode("utf-8", "surrogatepass")

    def find(self, texts: list[str]) -> np.ndarray:
        """Place of each text, -1 if it isn't stored."""
        keys = np.array([_digest(t) for t in texts], np.uint64)
        at = np.searchsorted(self.keys, keys)
        out = np.full(len(texts), -1, np.int64)
        inside = np.flatnonzero(at < len(self.keys))
        for i in inside[self.keys[at[inside]] == keys[inside]].tolist():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == keys[i]:  # entries whose digests collide follow each other
                if self.entry(k) == texts[i]:
                    out[i] = k
                    break
                k += 1
        return out


class UrlFilter:
    """Rules and block list as three digest arrays: rules (host + path), hosts that have rules, blocked hosts."""

    def __init__(self, base: str) -> None:
        self.rules, self.hosts, self.blocked = (DigestArray(f"{base}.{k}") for k in ("rules", "hosts", "blocked"))
        self.allow = np.fromfile(base + ".allow", np.uint8)
        self.first = np.fromfile(base + ".first", np.int64)
        self.lengths = np.fromfile(base + ".lengths", np.int64)

    @staticmethod
    def write(rules: dict[tuple[str, str], str], blocked: Iterable[str], base: str) -> list[str]:
        """Files of a filter; returns their names. Path lengths are kept per host, so only those are tried."""
        verdict = {host + path: v for (host, path), v in rules.items()}
        order = DigestArray.write(verdict, base + ".rules")
        np.array([verdict[e] == "allow" for e in order], np.uint8).tofile(base + ".allow")
        lengths: dict[str, set[int]] = {}
        for host, path in rules:
            lengths.setdefault(host, set()).add(len(path))
        hosts = DigestArray.write(lengths, base + ".hosts")
        np.cumsum([0] + [len(lengths[h]) for h in hosts], dtype=np.int64).tofile(base + ".first")
        np.array([n for h in hosts for n in sorted(lengths[h])], np.int64).tofile(base + ".lengths")
        DigestArray.write(blocked, base + ".blocked")
        return [f"{base}.{k}.{x}" for k in ("rules", "hosts", "blocked") for x in ("keys", "ends", "text")] + [f"{base}.{x}" for x in ("allow", "first", "lengths")]

    def judge(self, urls: list[str | None]) -> pd.DataFrame:
        pairs = [split_url(u) for u in urls]
        host_code, hosts = pd.factorize(np.array([h for h, _ in pairs], object))
        # every parent domain of every distinct host of the batch, probed at once
        parents, owner = [], []
        for k, host in enumerate(hosts):
            parts = host.split(".")
            parents += [".".join(parts[i:]) for i in range(len(parts))]
            owner += [k] * len(parts)
        with_rules, listed = self.hosts.find(parents), self.blocked.find(parents)
        bad = np.zeros(len(hosts), bool)
        bad[np.array(owner, np.int64)[listed >= 0]] = True
        tries: list[list[tuple[str, list[int]]]] = [[] for _ in hosts]
        for i in np.flatnonzero(with_rules >= 0).tolist():
            k = int(with_rules[i])
            tries[owner[i]].append((parents[i], self.lengths[self.first[k] : self.first[k + 1]].tolist()))
        keys, row, rank = [], [], []
        for r, (code, (_, path)) in enumerate(zip(host_code.tolist(), pairs, strict=True)):
            for host, sizes in tries[code]:
                for n in sizes:
                    if n <= len(path):
                        keys.append(host + path[:n])
                        row.append(r)
                        rank.append((len(host) + n, len(host)))
        distinct, names = pd.factorize(np.array(keys, object)) if keys else (np.zeros(0, np.int64), [])
        place = self.rules.find(list(names))[distinct] if keys else np.zeros(0, np.int64)
        best: dict[int, tuple[tuple[int, int], int, str]] = {}
        for i in np.flatnonzero(place >= 0).tolist():
            old = best.get(row[i])
            if old is None or rank[i] > old[0]:
                best[row[i]] = (rank[i], int(place[i]), keys[i])
        verdict = np.where(bad[host_code], "block", "allow").astype(object) if len(urls) else np.zeros(0, object)
        rule = np.full(len(urls), None, object)
        for r, (_, k, name) in best.items():
            rule[r] = name
            verdict[r] = "allow" if self.allow[k] else "block"
        return pd.DataFrame({"host": [h for h, _ in pairs], "path": [p for _, p in pairs], "rule": rule, "verdict": verdict})


_OPEN: dict[str, UrlFilter] = {}
_SHIPPED: dict[str, set[str]] = {}


def ship_filter(spark: SparkSession, rules: dict[tuple[str, str], str], blocked: Iterable[str]) -> str:
    """Writes a filter's files and hands them to all executors; returns the name to open it by."""
    blocked = sorted(set(blocked))
    content = repr((sorted(rules.items()), blocked)).encode("utf-8", "surrogatepass")
    name = f"urls-{hashlib.sha256(content).hexdigest()[:32]}"
    known = _SHIPPED.setdefault(spark.sparkContext.applicationId, set())
    if name not in known:  # equal filters are shipped once in an application
        for path in UrlFilter.write(rules, blocked, os.path.join(tempfile.mkdtemp(prefix="gridloom-"), name)):
            spark.sparkContext.addFile(path)
        known.add(name)
    return name


def judge_urls(pages: DataFrame, rules: dict[tuple[str, str], str], blocked: Iterable[str]) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``. rules: (host, path) -> allow or block."""
    name = ship_filter(pages.sparkSession, rules, blocked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _OPEN:
            _OPEN.clear()
            _OPEN[name] = UrlFilter(SparkFiles.get(name))
        for batch in batches:
            found = _OPEN[name].judge(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), *(pa.array(found[c].tolist(), pa.string()) for c in found)], ["page_id", *found])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
