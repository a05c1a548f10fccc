"""Byte-level BPE of a public vocabulary as numpy matrices.

Distinct pieces of a batch are bucketed by byte length and laid out as padded id
matrices. In each round every row merges its leftmost pair of minimum rank, found by
a hashed pair lookup, and the rows are compacted; a row leaves when no pair is left.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import regex

#: White space as Unicode's White_Space property has it; the C0 separators 1C-1F are not in it.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs that no pre-token crosses; a pre-token never spans two of them.
_RUNS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_NONE = np.int64(1 << 40)
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


class PairTable:
    """Open-addressing hash table of (left id, right id) -> merged id."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 3))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, _NONE, np.int64)
        self.longest = 1
        slot, left = self._slot(pairs), np.arange(len(pairs))
        while len(left):
            free = self.keys[slot[left]] == -1
            cand = left[free]
            _, first = np.unique(slot[cand], return_index=True)
            won = cand[first]
            self.keys[slot[won]], self.values[slot[won]] = pairs[won], merged[won]
            lost = np.ones(len(pairs), bool)
            lost[won] = False
            left = left[lost[left]]
            slot[left] = (slot[left] + 1) & (size - 1)
            self.longest += 1

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        flat = pairs.ravel()
        slot, out = self._slot(flat), np.full(len(flat), _NONE, np.int64)
        todo = np.arange(len(flat))
        for _ in range(self.longest):
            key = self.keys[slot[todo]]
            hit = key == flat[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (key != -1)]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out.reshape(pairs.shape)


class Encoder:
    """Encoder of one rank file; `pattern` splits text into pre-tokens."""

    def __init__(self, path: str, pattern: str, cache_size: int = 300_000) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.pattern, self.cache_size = regex.compile(pattern), cache_size
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left << 20 | right)
                    merged.append(rank)
        self.table = PairTable(np.array(pairs, np.int64), np.array(merged, np.int64))
        self.runs: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _merge(self, pieces: list[str]) -> None:
        """Put the ids of each new piece into the cache."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        by_length: dict[int, list[int]] = {}
        for k, b in enumerate(raw):
            n = len(b)
            by_length.setdefault(n if n <= 8 else 1 << (n - 1).bit_length(), []).append(k)
        for width, members in by_length.items():
            step = max(1, 1_000_000 // width)
            for at in range(0, len(members), step):
                self._rounds(pieces, raw, members[at : at + step], width)

    def _rounds(self, pieces: list[str], raw: list[bytes], members: list[int], width: int) -> None:
        lengths = np.array([len(raw[k]) for k in members])
        ids = np.full((len(members), width), -1, np.int64)
        ids[np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(raw[k] for k in members), np.uint8)]
        rows = np.array(members)
        rank = np.full((len(members), max(width - 1, 1)), _NONE, np.int64)
        if width > 1:
            known = ids[:, 1:] >= 0
            rank[known] = self.table.find(ids[:, :-1][known] << 20 | ids[:, 1:][known])
        while True:
            best = rank.argmin(1)
            low = rank[np.arange(len(rows)), best]
            done = low >= _NONE
            if done.any():
                block, stride = ids[done].astype("<i4").tobytes(), ids.shape[1] * 4
                for j, (k, n) in enumerate(zip(rows[done].tolist(), lengths[done].tolist())):
                    self.pieces[pieces[k]] = block[j * stride : j * stride + 4 * n]
                keep = ~done
                rows, lengths, ids, rank, best, low = rows[keep], lengths[keep], ids[keep], rank[keep], best[keep], low[keep]
            if not len(rows):
                return
            at = np.arange(len(rows))
            # compaction: everything right of the merged pair moves one column left
            columns = np.arange(ids.shape[1] - 1)
            ids[at, best] = low
            ids[:, :-1] = np.where(columns > best[:, None], ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            if rank.shape[1] > 1:
                rank[:, :-1] = np.where(columns[:-1] > best[:, None], rank[:, 1:], rank[:, :-1])
                rank[:, -1] = _NONE
            else:
                rank[:] = _NONE
            lengths -= 1
            for side in (best - 1, best):
                ok = (side >= 0) & (side + 1 < lengths)
                rank[at[ok], side[ok]] = self.table.find(ids[at[ok], side[ok]] << 20 | ids[at[ok], side[ok] + 1])
                gone = (side >= 0) & (side < rank.shape[1]) & (side + 1 >= lengths)
                rank[at[gone], side[gone]] = _NONE
            most = int(lengths.max())
            if most < ids.shape[1] // 2:
                ids, rank = ids[:, :most].copy(), rank[:, : max(1, most - 1)].copy()

    def _learn(self, runs: set[str]) -> None:
        if len(self.runs) > self.cache_size or len(self.pieces) > self.cache_size:
            self.runs.clear()
            self.pieces.clear()
        # a run of letters is one pre-token, with or without its leading blank
        whole = [run for run in runs if run.isalpha() or (run[0] == " " and run[1:].isalpha())]
        findall, pieces = self.pattern.findall, self.pieces
        split = {run: findall(run) for run in runs.difference(whole)}
        new = {p for parts in split.values() for p in parts}
        new.update(whole)
        self._merge([p for p in new if p not in pieces])
        for run in whole:
            self.runs[run] = pieces[run]
        for run, parts in split.items():
            self.runs[run] = b"".join([pieces[p] for p in parts])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian int32; null and empty texts have none."""
        out, group, size = [], [], 0
        for text in texts:
            group.append(_RUNS.findall(text) if text else ())
            size += len(text or "")
            if size > 4_000_000:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, group: list) -> list[bytes]:
        new: set[str] = set()
        for runs in group:
            new.update(runs)
        known = self.runs.keys()
        if not new <= known:
            if len(self.runs) > self.cache_size or len(self.pieces) > self.cache_size:
                self.runs.clear()
                self.pieces.clear()
            self._learn(new - self.runs.keys())
        get = self.runs.__getitem__
        return [b"".join(map(get, runs)) for runs in group]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder; `path` is the rank file, by default the public byte_bpe_50k."""
    import public_tokenizers as public

    key = (path or str(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
