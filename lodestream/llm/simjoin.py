"""Set-similarity join by vertical partitioning, shared by problems 3 and 5.

The set of a record is its different windows of 9 letters and digits. All windows have one global order,
rare first: a sketch of counts over all records (``2**sketch_bits`` counters, so of bounded size) gives
the rarity, the hash breaks ties; a poor sketch costs time, never a pair. That order is cut into
``fragments`` fragments by hash, each record's prefix into segments, and each fragment counts the overlap
of its segments on its own; the partial overlaps of a pair are summed.

Which pairs can be left out, exactly: of two sets of sizes ``nx <= ny`` with similarity ``>= t`` at least
``o = ceil(t / (1 + t) * (nx + ny))`` windows are shared, so their prefixes of ``n - ceil(t * n) + 1 +
ext(n)`` windows share at least ``L = min(o - n + prefix(n))`` over both, and one of ``F`` fragments at
least ``ceil(L / F)``. Inside a fragment one side's windows are listed by token and size, once for the
smaller and once for the larger of a pair, as far as enough of their segment is left for some partner; the
other side is looked up in bands, then XOR of parity signatures bounds the overlap, then segments are
intersected. What is left after summing is verified on the whole
sets.

How it spreads: rows of the shuffle are blocks of many records' segments, so the shuffle holds about
5 bytes a prefix window; up to ``GROUP_RECORDS`` records a fragment is one group. Beyond that nothing is
shuffled: the blocks are a table by fragment, of which ``PROBE_RECORDS`` records at a time travel to all
that come before them (``met``), so neither a task nor the disk in use follows the number of records.
Texts are fetched only for records with a candidate.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import window_hashes
from lodestream.session import exists

GRAM = 9
THRESHOLD = 0.7
MIN_CHARS = 150
EXTRA = 0.1
SKETCH_BITS = 22
FRAGMENTS = 6
GROUP_RECORDS = 250_000
PROBE_RECORDS = 30_000
NEVER = 1 << 40
_SLICES = 64
_BATCH = 500
_BAND_TOKENS = 400_000
_CHUNK = 80_000
_FEW = 4
_SHORT = 8
_LONG = 32
_MARK_BITS = 22
_PENDING = 4_000_000
_SKETCH_BUFFER = 6_000_000
_UNIT_RECORDS = 10_000
_TASK_RECORDS = 250_000
_PIECE_RECORDS = 40_000
_SLOT_BITS = 22


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def squashed(text: str) -> np.ndarray:
    """Lower-case, letters and digits only, as code points."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return points[_letters()[points]]


def squashed_batch(titles, contents, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The squashed title and content of a batch in one array, each record's end, and who takes part.

    All texts are looked up at once; a record whose content is too short keeps nothing.
    """
    texts = [t for pair in zip(titles, contents) for t in ((pair[0] or "").lower(), (pair[1] or "").lower())]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    held = _letters()[points]
    counts = np.diff(np.concatenate([[0], np.cumsum(held)])[np.concatenate([[0], np.cumsum(lengths)])])
    takes = counts[1::2] >= min_chars
    whole = counts[::2] + counts[1::2]
    points = points[held]
    if not takes.all():
        points = points[np.repeat(takes, whole)]
    return points, np.cumsum(np.where(takes, whole, 0)), takes


def _distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order; sorting beats hashing here."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def set_of(points: np.ndarray, gram: int = GRAM) -> np.ndarray:
    return _distinct(window_hashes(points, gram))


def key_of(points: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of the squashed text."""
    return tuple(np.frombuffer(hashlib.blake2b(points.tobytes(), digest_size=16).digest(), np.int64))


def _texts(batches: Iterator[pd.DataFrame], min_chars: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Of each part of a batch: the records that take part, their characters in one array, and their edges in it."""
    for pdf in batches:
        for at in range(0, len(pdf), _BATCH):
            part = pdf.iloc[at : at + _BATCH]
            points, ends, takes = squashed_batch(part["title"], part["content"], min_chars)
            yield part[takes], points, np.concatenate([[0], ends[takes]])


def _keys(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.array([key_of(points[a:b]) for a, b in zip(edges[:-1], edges[1:])], np.int64).reshape(-1, 2)


SCANNED = "harvest_id string, k1 long, k2 long, slice int, slot int, counts binary"


def scanned(records: DataFrame, gram: int = GRAM, min_chars: int = MIN_CHARS, bits: int = SKETCH_BITS) -> DataFrame:
    """One scan of the texts for two things: the key of each record that takes part, and a count sketch of each task's windows."""
    width = 1 << bits

    def rows(batches):
        counts = np.zeros(width, np.int64)
        waiting, held = [], 0
        for part, points, edges in _texts(batches, min_chars):
            keys = _keys(points, edges)
            yield pd.DataFrame({"harvest_id": part["harvest_id"], "k1": keys[:, 0], "k2": keys[:, 1], "slice": None, "slot": None, "counts": None})
            # the few windows over the edge of two records do not matter for rarity
            waiting.append((window_hashes(points, gram) >> np.uint64(64 - bits)).astype(np.int32))
            held += len(waiting[-1])
            if held > _SKETCH_BUFFER:
                counts += np.bincount(np.concatenate(waiting), minlength=width)
                waiting, held = [], 0
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=width)
        if counts.any():
            slot = int(counts[:: width // 64].sum()) % 16
            for s, own in enumerate(np.split(counts, _SLICES)):
                yield pd.DataFrame({"harvest_id": None, "k1": None, "k2": None, "slice": [s], "slot": [slot], "counts": [zlib.compress(own.astype(np.uint32).tobytes(), 1)]})

    return records.mapInPandas(rows, SCANNED)


def members(scan: DataFrame) -> DataFrame:
    """``harvest_id, k1, k2`` of the records that take part."""
    return scan.filter("counts IS NULL").select("harvest_id", "k1", "k2").distinct()


def rarity(scan: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """For each of ``2**bits`` counters the level of its count over all records (logarithmic, one byte)."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), np.uint32).astype(np.int64) for c in pdf["counts"])
        total = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "slot": [0], "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = "slice int, slot int, counts binary"
    part = scan.filter("counts IS NOT NULL").select("slice", "slot", "counts")
    part = part.groupBy("slice", "slot").applyInPandas(add, schema).groupBy("slice").applyInPandas(add, schema)
    out = np.zeros((_SLICES, (1 << bits) // _SLICES), np.uint8)
    for row in part.mapInPandas(_levels, "slice int, level binary").toLocalIterator():
        out[row["slice"]] = np.frombuffer(zlib.decompress(row["level"]), np.uint8)
    return out.reshape(-1)


def _levels(batches):
    for pdf in batches:
        levels = [zlib.compress(np.minimum(255, 6 * np.log2(1.0 + np.frombuffer(zlib.decompress(c), np.uint32))).astype(np.uint8).tobytes(), 1) for c in pdf["counts"]]
        yield pd.DataFrame({"slice": pdf["slice"], "level": levels})


def prefix_size(n, threshold: float = THRESHOLD, extra: float = EXTRA):
    """Windows of a set of ``n`` that are indexed, and how many of them are extra."""
    n = np.asarray(n, np.int64)
    ext = np.floor(extra * n).astype(np.int64)
    return np.minimum(n, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1 + ext), ext


def least_shared(nx, ny, threshold: float = THRESHOLD, extra: float = EXTRA):
    """The least number of windows the prefixes of a similar pair share."""
    need = np.ceil(threshold / (1 + threshold) * (nx + ny) - 1e-9).astype(np.int64)
    return np.minimum(need - nx + prefix_size(nx, threshold, extra)[0], need - ny + prefix_size(ny, threshold, extra)[0])


SEGMENTS = "fragment int, unit long, part int, slice int, slices int, keys binary, sizes binary, counts binary, tokens binary"
PARTIAL = "fragment int, ax long, bx long, ay long, by long, nx int, ny int, shared int"
PAIR = ["ax", "bx", "ay", "by"]
_HOT_BIT = np.uint32(1 << 31)


def level_of(count: int) -> int:
    return int(min(255, 6 * np.log2(1.0 + count)))


def count_of(level: int) -> int:
    return int(2 ** ((level + 1) / 6))


@dataclass(frozen=True)
class Plan:
    """How the segments spread over groups.

    There are always ``fragments`` fragments, so the bounds stay as sharp as they are, and by default a
    fragment is one group. A caller that groups by shuffle may split it: tokens go to ``parts`` parts by
    hash, and a segment is sent to each part that holds one of its tokens, so as often as it has tokens; a
    token that the sketch counts ``hot`` times or more has groups of its own, among which the records are
    sliced. Either sends whole segments many times over, which is why ``met`` does without.
    """

    fragments: int = FRAGMENTS
    parts: int = 1
    hot: int = NEVER

    def groups(self, tokens: np.ndarray, owner: np.ndarray, level: np.ndarray) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
        """``(part, slice, slices), records`` of each group that segments go to."""
        heavy = (tokens & _HOT_BIT) > 0
        light, of = tokens[~heavy], owner[~heavy]
        if self.parts == 1:
            yield (0, 0, 1), np.unique(of)
        else:
            both = np.unique((light % np.uint32(self.parts)).astype(np.int64) << 32 | of)
            part, of = both >> 32, both & 0xFFFFFFFF
            for p in np.unique(part):
                yield (int(p), 0, 1), of[part == p]
        for t in np.unique(tokens[heavy]):
            own = tokens == t
            slices = -(-count_of(int(level[own][0])) // self.hot)
            for s in range(slices):
                yield (-1 - int(t ^ _HOT_BIT), s, slices), np.unique(owner[own])

    def wanted(self, part: int | None, tokens: np.ndarray) -> np.ndarray:
        """Which tokens of its segments a group looks up; all of them where a fragment is taken whole (no part)."""
        if part is None:
            return np.ones(len(tokens), bool)
        if part < 0:
            return tokens == (np.uint32(-1 - part) | _HOT_BIT)
        light = (tokens & _HOT_BIT) == 0
        return light & (tokens % np.uint32(self.parts) == part) if self.parts > 1 else light


def segments(records: DataFrame, levels, plan: Plan, gram: int = GRAM, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """``SEGMENTS``: blocks of the records' prefix segments, sent to the groups that need them.

    ``levels`` is a broadcast of ``rarity``. The tokens of a segment are in the global order. ``unit``
    numbers runs of records, the same in all fragments: of the task and of ``_UNIT_RECORDS`` within it.
    Records that come with the key of their text, ``k1`` and ``k2``, are not keyed again.
    """

    def rows(batches):
        level, task, done = levels.value, TaskContext.get().partitionId() << 24, 0
        shift = np.uint64(64 - int(len(level)).bit_length() + 1)
        heavy = level_of(plan.hot)
        for part, points, edges in _texts(batches, min_chars):
            if not len(part):
                continue
            hashes = window_hashes(points, gram)
            sets = [_distinct(hashes[a : b - gram + 1]) for a, b in zip(edges[:-1], edges[1:])]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            counts = prefix_size(sizes, threshold)[0]
            ranks = level[(np.concatenate(sets) >> shift).astype(np.int64)]
            ends = np.cumsum(sizes)
            # a set is sorted, so a stable sort by level gives the global order
            first = np.concatenate([e - len(h) + np.argsort(ranks[e - len(h) : e], kind="stable")[:n] for h, e, n in zip(sets, ends, counts)])
            tokens, seen = np.concatenate(sets)[first], ranks[first]
            owner = np.repeat(np.arange(len(sets)), counts)
            fragment = (tokens % np.uint64(plan.fragments)).astype(np.int64)
            order = np.argsort(fragment, kind="stable")
            tokens, owner, seen = (tokens[order] // np.uint64(plan.fragments)).astype(np.uint32) & ~_HOT_BIT, owner[order], seen[order]
            tokens[seen >= heavy] |= _HOT_BIT
            keys, sizes = part[["k1", "k2"]].to_numpy(np.int64) if "k1" in part else _keys(points, edges), sizes.astype(np.int32)
            cuts = np.searchsorted(fragment[order], np.arange(plan.fragments + 1))
            out = []
            for f in range(plan.fragments):
                own, of = tokens[cuts[f] : cuts[f + 1]], owner[cuts[f] : cuts[f + 1]]
                n = np.bincount(of, minlength=len(sizes))
                starts = np.cumsum(n) - n
                for group, held in plan.groups(own, of, seen[cuts[f] : cuts[f + 1]]):
                    if len(held):
                        out.append((f, task | done // _UNIT_RECORDS, *group, keys[held].tobytes(), sizes[held].tobytes(), n[held].astype(np.uint32).tobytes(), own[_ranges(starts[held], n[held])].tobytes()))
            done += len(part)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    return records.mapInPandas(rows, SEGMENTS)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i] ... starts[i] + lengths[i] - 1`` of all ``i``, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Side:
    """The segments of one fragment, different keys only, in order of size (and key, so that all fragments agree)."""

    def __init__(self, pdf: pd.DataFrame, plan: Plan, threshold: float, extra: float) -> None:
        join = lambda c, kind: np.frombuffer(b"".join(pdf[c]), kind)
        keys, sizes, counts = join("keys", np.int64).reshape(-1, 2), join("sizes", np.int32), join("counts", np.uint32).astype(np.int64)
        order = np.lexsort((keys[:, 1], keys[:, 0], sizes))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
        held = order[fresh]
        starts = np.cumsum(counts) - counts
        self.keys, self.sizes, self.counts = keys[held], sizes[held].astype(np.int64), counts[held]
        self.tokens = join("tokens", np.uint32)[_ranges(starts[held], self.counts)]
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.owner = np.repeat(np.arange(len(held), dtype=np.int32), self.counts)
        self.slope = prefix_size(self.sizes, threshold, extra)[0] - self.sizes
        self.plan, self.kind, self.ratio = plan, (threshold, extra), threshold / (1 + threshold)
        # what the windows of the segment from here on allow a partner to ask for, times the fragments
        ends = self.starts[1:] * plan.fragments - self.ratio * self.sizes
        self.room = (np.repeat(ends, self.counts) - plan.fragments * np.arange(len(self.owner))).astype(np.float32)
        self._signatures: dict[int, np.ndarray] = {}
        self._known: np.ndarray | None = None

    def signatures(self, words: int) -> np.ndarray:
        """Per record the parity of its segment's tokens in ``words`` words of 64 bits; fewer words are the longest ones folded."""
        if words not in self._signatures:
            if words == _LONG:
                mixed = (self.tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
                out = np.zeros(len(self.sizes) * words, np.uint64)
                np.bitwise_xor.at(out, self.owner * np.int64(words) + ((mixed >> np.uint64(6)) % np.uint64(words)).astype(np.int64), np.uint64(1) << (mixed & np.uint64(63)))
                self._signatures[words] = out.reshape(-1, words)
            else:
                self._signatures[words] = np.bitwise_xor.reduce(self.signatures(_LONG).reshape(len(self.sizes), -1, words), axis=1)
        return self._signatures[words]

    def known(self) -> np.ndarray:
        """By slot, whether there may be such a token."""
        if self._known is None:
            self._known = np.zeros(1 << _SLOT_BITS, bool)
            self._known[_slots(self.tokens)] = True
        return self._known

    def reach(self, a: int, b: int, low: float, high: float, slack) -> np.ndarray:
        """Which windows of records ``a`` to ``b`` have enough of their segment left for some partner of ``low`` to ``high`` times the size; rounding costs 2."""
        n, falls = self.sizes[a:b], self.kind[1] - self.kind[0]
        least = np.minimum(*(self.ratio * (n + m * n) + np.minimum(self.slope[a:b], falls * m * n - 1) for m in (low, high)))
        return self.room[self.starts[a] : self.starts[b]] >= np.repeat((least - self.ratio * n - 2 - slack).astype(np.float32), self.counts[a:b])

    def lists(self, mask: np.ndarray, low: float, high: float, slack) -> tuple[np.ndarray, ...]:
        """The windows of ``mask`` that partners of ``low`` to ``high`` times the size may meet, by token and then size: token and place as one key, owner, what they have left, what they ask."""
        held = np.flatnonzero(mask & self.reach(0, len(self.sizes), low, high, slack))
        key = np.sort(self.tokens[held].astype(np.uint64) << np.uint64(32) | held.astype(np.uint64))
        at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        owner = self.owner.take(at).astype(np.int64)
        bend = self.slope if high <= 1 else 0  # the larger of the two has the lower slope
        return key, owner, self.room.take(at) - bend.astype(np.float32).take(owner) if high <= 1 else self.room.take(at), (self.ratio * self.sizes + bend).astype(np.float32).take(owner)


def _likely(s: Side, t: Side, x: np.ndarray, y: np.ndarray, room: np.ndarray, words: int) -> np.ndarray:
    """Pairs whose parity signatures differ in at most ``room`` places."""
    ok = np.empty(len(x), bool)
    one, two = s.signatures(words), t.signatures(words)
    for at in range(0, len(x), 20_000):
        i = slice(at, at + 20_000)
        ok[i] = np.bitwise_count(one[x[i]] ^ two[y[i]]).sum(axis=1, dtype=np.int64) <= room[i]
    return ok


def partial_overlaps(s: Side, t: Side, plan: Plan, threshold: float, extra: float, part: int | None = None, role: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``x, y, shared`` of the pairs of records of ``s`` and ``t`` whose segments share their part of the bound.

    Where both are the same side each pair comes once, ``x`` before ``y``. ``role`` says which records
    of ``t`` are looked up. ``t`` is taken in bands of ``_BAND_TOKENS`` windows, so the memory in use
    does not follow the number of pairs.
    """
    same, ratio, parts = s is t, threshold / (1 + threshold), plan.fragments
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    looked = plan.wanted(part, t.tokens)
    asked = looked if same else plan.wanted(part, s.tokens) & t.known().take(_slots(s.tokens))
    if role is not None:
        looked = looked & role[t.owner]
    slack = np.float32(1 + 2.0**-21 * parts * max([1, *s.sizes[-1:], *t.sizes[-1:]]))
    # partners that are smaller, and such that are not: what a window must have left depends on which is the larger
    sides = [(threshold, 1.0)] if same else [(threshold, 1.0), (1.0, 1 / threshold)]
    lists = [s.lists(asked, 1 / high, 1 / low, slack) for low, high in sides]

    a = 0
    while a < len(t.sizes):
        b = max(a + 1, int(np.searchsorted(t.starts, t.starts[a] + _BAND_TOKENS, "right")) - 1)
        x, y = _meet(s, t, sides, lists, looked, parts, threshold, slack, a, b)
        if len(x):
            need = np.ceil(ratio * (s.sizes[x] + t.sizes[y]) - 1e-9) + np.minimum(s.slope[x], t.slope[y])
            bound = np.maximum(1, np.ceil(need / parts - 1e-9)).astype(np.int64)
            for words in (_SHORT, _LONG):
                ok = _likely(s, t, x, y, s.counts[x] + t.counts[y] - 2 * bound, words)
                x, y, bound = x[ok], y[ok], bound[ok]
            shared = _overlaps(s, t, x, y)
            ok = (shared >= bound) & (s.keys[x] != t.keys[y]).any(axis=1)
            out.append((x[ok], y[ok], shared[ok]))
        a = b
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _meet(s: Side, t: Side, sides: list[tuple[float, float]], lists: list[tuple[np.ndarray, ...]], looked: np.ndarray, parts: int, threshold: float, slack, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs with a record ``a`` to ``b`` of ``t`` that meet in a window with enough of both segments left.

    A list holds the records of ``s`` by size, so the partners of a record of ``t`` are a run of it.
    """
    ratio, width, share = threshold / (1 + threshold), b - a, np.float32(2 / parts)
    n, q0, q1 = t.sizes[a:b], t.starts[a], t.starts[b]
    owner, size = t.owner[q0:q1] - a, (ratio * n).astype(np.float32)
    first, equal = np.searchsorted(s.sizes, np.ceil(threshold * n - 1e-9)), np.arange(a, b) if s is t else np.searchsorted(s.sizes, n)
    last = np.searchsorted(s.sizes, np.floor(n / threshold + 1e-9), "right")
    one, two = s.signatures(_FEW).T.copy(), t.signatures(_FEW)[a:b].T.copy()
    out, pending, most = [], 0, _PENDING
    for (low, high), (key, x_of, left, asks), r0, r1 in zip(sides, lists, (first, equal), (equal, last)):
        theirs = np.flatnonzero(looked[q0:q1] & t.reach(a, b, low, high, slack))
        asking = np.sort(t.tokens[q0:q1].take(theirs).astype(np.uint64) << np.uint64(32) | theirs.astype(np.uint64))
        at = (asking & np.uint64(0xFFFFFFFF)).astype(np.int64)
        y_of, token = owner.take(at).astype(np.int64), asking & np.uint64(0xFFFFFFFF << 32)
        lo = np.searchsorted(key, token | s.starts[r0].astype(np.uint64).take(y_of))
        hi = np.searchsorted(key, token | s.starts[r1].astype(np.uint64).take(y_of))
        met = np.flatnonzero(hi > lo)
        y_of, lo, times, at = y_of[met], lo[met], (hi - lo)[met], at[met]
        bend = (t.slope[a:b] if high <= 1 else np.zeros(width)).astype(np.float32)  # as in ``lists``
        room, ask = t.room[q0:q1].take(at) - bend.take(y_of) + 2 + slack, (size + bend - 2 - slack).take(y_of)
        # what the signatures of a pair may differ in: what both hold less twice what they must share
        held_s = (s.counts - share * (ratio * s.sizes + (s.slope if high > 1 else 0))).astype(np.float32)
        held_t = (t.counts[a:b] - share * (size + bend - 2 - slack)).astype(np.float32)
        edges = np.concatenate([[0], np.cumsum(times)])
        i = 0
        while i < len(times):
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + _CHUNK, "right")) - 1)
            for at in range(0, int(edges[j] - edges[i]), 4 * _CHUNK):  # a single long list is taken in parts
                each = times[i:j] if j > i + 1 else np.minimum(times[i:j] - at, 4 * _CHUNK)
                k = np.arange(at, at + each.sum()) + np.repeat(lo[i:j] - edges[i:j] + edges[i], each)
                ok = np.flatnonzero((left.take(k) >= np.repeat(ask[i:j], each)) & (asks.take(k) <= np.repeat(room[i:j], each)))
                x, y = x_of.take(k.take(ok)), np.repeat(y_of[i:j], each).take(ok)
                # a short parity signature drops most pairs where they meet
                differ = np.zeros(len(x), np.uint16)
                for w in range(_FEW):
                    differ += np.bitwise_count(one[w].take(x) ^ two[w].take(y))
                ok = np.flatnonzero(differ <= held_s.take(x) + held_t.take(y))
                if len(ok):
                    out.append(x.take(ok) * width + y.take(ok))
                    pending += len(ok)
                    if pending > most:
                        out = [_distinct(np.concatenate(out))]
                        pending, most = 0, max(_PENDING, len(out[0]) // 2)
            i = j
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = np.divmod(_distinct(np.concatenate(out)), width)
    return x, y + a


def _overlaps(s: Side, t: Side, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shared tokens of the segments of each pair, at times too many: the tokens of each ``y`` are marked once for all its partners."""
    marked = np.zeros(1 << _MARK_BITS, bool)
    slot = lambda tokens: (tokens * np.uint32(0x9E3779B1)) >> np.uint32(32 - _MARK_BITS)
    shared = np.zeros(len(x), np.int64)
    order = np.argsort(y, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], y[order][1:] != y[order][:-1], [True]])) if len(y) else []
    for i, j in zip(edges[:-1], edges[1:]):
        own = slot(t.tokens[t.starts[y[order[i]]] : t.starts[y[order[i]] + 1]])
        marked[own] = True
        for at in range(i, j, 20_000):  # a record with many partners is done in parts
            pick = order[at : min(j, at + 20_000)]
            c = s.counts[x[pick]]
            shared[pick] = np.add.reduceat(marked[slot(s.tokens[_ranges(s.starts[x[pick]], c)])], np.cumsum(c) - c, dtype=np.int64)
        marked[own] = False
    return shared


def partial_rows(s: Side, t: Side, found: tuple[np.ndarray, np.ndarray, np.ndarray], fragment: int) -> pd.DataFrame:
    x, y, shared = found
    return pd.DataFrame({
        "fragment": np.full(len(x), fragment), "ax": s.keys[x, 0], "bx": s.keys[x, 1], "ay": t.keys[y, 0], "by": t.keys[y, 1], "nx": s.sizes[x], "ny": t.sizes[y], "shared": shared,
    })


def summed(partial: DataFrame, plan: Plan, threshold: float = THRESHOLD, extra: float = EXTRA) -> DataFrame:
    """``ax, bx, ay, by``: the pairs whose partial overlaps, one of each fragment, sum up to what can reach the bound."""

    def enough(shared: pd.Series, held: pd.Series, nx: pd.Series, ny: pd.Series) -> pd.Series:
        need = least_shared(nx.to_numpy(), ny.to_numpy(), threshold, extra)
        # fragments that did not report the pair hold less than their share
        return shared + (plan.fragments - held) * (np.maximum(1, -(-need // plan.fragments)) - 1) >= need

    # several parts of a fragment may report a pair, each with the same overlap
    own = [F.max(F.when(F.col("fragment") == f, F.col("shared"))) for f in range(plan.fragments)]
    total, held = (sum((f(c) for c in own[1:]), f(own[0])) for f in (lambda c: F.coalesce(c, F.lit(0)), lambda c: F.when(c.isNull(), 0).otherwise(1)))
    pairs = partial.groupBy(*PAIR, "nx", "ny").agg(total.alias("shared"), held.alias("held"))
    return pairs.filter(F.pandas_udf(enough, "boolean")("shared", "held", "nx", "ny")).select(*PAIR)


def partials(blocks: DataFrame, plan: Plan, threshold: float = THRESHOLD, extra: float = EXTRA) -> DataFrame:
    """``PARTIAL``: the partial overlaps of all pairs of records of the blocks."""

    def count(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fragment, part, own, slices = (int(g) for g in group)
        side = Side(pdf, plan, threshold, extra)
        role = None if slices == 1 else (side.keys[:, 0] % slices) == own
        return partial_rows(side, side, partial_overlaps(side, side, plan, threshold, extra, part, role), fragment)

    # a partition for few groups each, which nothing merges again: a group is long work on little data
    spread = blocks.repartition(min(4 * plan.fragments * plan.parts, 4000), "fragment", "part", "slice")
    return spread.groupBy("fragment", "part", "slice", "slices").applyInPandas(count, PARTIAL)


def candidates(blocks: DataFrame, plan: Plan, threshold: float = THRESHOLD, extra: float = EXTRA) -> DataFrame:
    """``ax, bx, ay, by``: the pairs of keys, among all, whose summed partial overlaps can reach the bound."""
    return summed(partials(blocks, plan, threshold, extra), plan, threshold, extra)


def _slots(tokens) -> np.ndarray:
    return (tokens * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOT_BITS)


def _near(old: dict, known: np.ndarray, plan: Plan, threshold: float, extra: float) -> dict:
    """A block without the records that share fewer windows with the probes than any partner asks."""
    sizes, counts = np.frombuffer(old["sizes"], np.int32).astype(np.int64), np.frombuffer(old["counts"], np.uint32).astype(np.int64)
    tokens = np.frombuffer(old["tokens"], np.uint32)
    low, high = np.ceil(threshold * sizes).astype(np.int64), (sizes / threshold).astype(np.int64)
    need = np.minimum(least_shared(sizes, low, threshold, extra), least_shared(sizes, high, threshold, extra)) - 2
    starts = np.cumsum(counts) - counts
    held = np.add.reduceat(known[_slots(tokens)], starts, dtype=np.int64) * plan.fragments >= need
    return {"keys": np.frombuffer(old["keys"], np.int64).reshape(-1, 2)[held].tobytes(), "sizes": sizes[held].astype(np.int32).tobytes(), "counts": counts[held].astype(np.uint32).tobytes(), "tokens": tokens[np.repeat(held, counts)].tobytes()}


def _probed(shared, plan: Plan, threshold: float, extra: float):
    """Partial overlaps of blocks with the broadcast probes, a fragment and ``_PIECE_RECORDS`` records at a time."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides: dict[int, Side] = {}
        waiting: dict[int, list[dict]] = {}
        held: dict[int, int] = {}

        def count(f: int) -> pd.DataFrame:
            old = Side(pd.DataFrame(waiting.pop(f)), plan, threshold, extra)
            x, y, shared = partial_overlaps(old, sides[f], plan, threshold, extra)
            return partial_rows(sides[f], old, (y, x, shared), f)

        for pdf in batches:
            for row in pdf.to_dict("records"):
                f = row["fragment"]
                if f not in sides:
                    sides[f] = Side(shared.value[f].to_pandas(), plan, threshold, extra)
                near = _near(row, sides[f].known(), plan, threshold, extra)
                if near["sizes"]:
                    waiting.setdefault(f, []).append(near)
                    held[f] = held.get(f, 0) + len(near["sizes"]) // 4
                    if held[f] >= _PIECE_RECORDS:
                        yield count(f)
                        held[f] = 0
        for f in list(waiting):
            yield count(f)

    return rows


def _among(shared, plan: Plan, threshold: float, extra: float):
    """Partial overlaps of the probes among themselves; a row is the number of a fragment."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f in pdf["id"]:
                if f in shared.value:
                    side = Side(shared.value[f].to_pandas(), plan, threshold, extra)
                    yield partial_rows(side, side, partial_overlaps(side, side, plan, threshold, extra), f)

    return rows


def _rounds(new: DataFrame, probe: int) -> list[tuple[int, int, int]]:
    """``first, last, before``: runs of units of at most ``probe`` records, or of one unit, and the records before them."""
    held = new.groupBy("unit", "fragment").agg(F.sum(F.length("sizes") / 4).alias("n")).groupBy("unit").agg(F.max("n").cast("long").alias("n"))
    out: list[list[int]] = []
    before = size = 0
    for row in held.orderBy("unit").collect():
        if out and size + row["n"] <= probe:
            out[-1][1], size = row["unit"], size + row["n"]
        else:
            before, size = before + size, row["n"]
            out.append([row["unit"], row["unit"], before])
    return [tuple(r) for r in out]


def met(new: DataFrame, past: DataFrame | None, held: int, plan: Plan, path: str, threshold: float = THRESHOLD, extra: float = EXTRA, probe: int = PROBE_RECORDS, records: int | None = None) -> DataFrame:
    """``ax, bx, ay, by``: the pairs of keys of new segments, among themselves and with ``held`` records of the past, that can reach the bound.

    ``new`` and ``past`` are stored tables of ``SEGMENTS`` partitioned by fragment; pairs are gathered
    below ``path``. ``probe`` records of ``new`` at a time are broadcast to where the past and the units of
    ``new`` before them lie: a task takes ``_PIECE_RECORDS`` of those at once, none of them is shuffled,
    and a pair is found in one round only. ``records``, if known to be that few, saves counting them.
    """
    spark = new.sparkSession
    columns = ["fragment", "keys", "sizes", "counts", "tokens"]
    whole = records is not None and records <= probe
    for number, (first, last, before) in enumerate([(None, None, 0)] if whole else _rounds(new, probe)):
        own = new if whole else new.filter(F.col("unit").between(first, last))
        sent = own.select(columns).toArrow()
        blocks = {f: sent.filter(pc.equal(sent["fragment"], f)) for f in sent["fragment"].unique().to_pylist()}
        shared = spark.sparkContext.broadcast(blocks)
        partial = [spark.range(0, plan.fragments, 1, plan.fragments).mapInPandas(_among(shared, plan, threshold, extra), PARTIAL)]
        olds = ([past] if past is not None else []) + ([new.filter(F.col("unit") < first)] if before else [])
        if olds:
            # two tasks a fragment at least: a union of single partitions would be taken for one
            old, tasks = reduce(DataFrame.unionByName, [o.select(columns) for o in olds]), 2 + (held + before) // _TASK_RECORDS
            partial += [old.filter(F.col("fragment") == f).coalesce(tasks).mapInPandas(_probed(shared, plan, threshold, extra), PARTIAL) for f in blocks]
        summed(reduce(DataFrame.unionByName, partial), plan, threshold, extra).write.parquet(f"{path}/round={number}")
        shared.destroy()
        del sent, blocks
    schema = ", ".join(f"{c} long" for c in PAIR)
    return spark.read.schema(schema).parquet(path).select(*PAIR) if exists(spark, path) else spark.createDataFrame([], schema)


def alike(threshold: float = THRESHOLD, gram: int = GRAM):
    """The pairs of the rows whose texts ``tx`` and ``ty`` are similar enough."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict[int, np.ndarray] = {}
            keep = []
            for own, tx, ty in zip(pdf["ax"], pdf["tx"], pdf["ty"]):
                if own not in known:
                    known[own] = _set_of_text(tx, gram)
                x, y = known[own], _set_of_text(ty, gram)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= threshold * (len(x) + len(y) - shared) - 1e-9)
            yield pdf.loc[keep, PAIR]

    return rows


def _set_of_text(t, gram: int) -> np.ndarray:
    return set_of(np.concatenate([squashed(t["title"] or ""), squashed(t["content"] or "")]), gram)


def verified(pairs: DataFrame, x_texts: DataFrame, y_texts: DataFrame, gram: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """``ax, bx, ay, by, shared, union`` of the pairs whose whole sets are similar enough."""

    def overlap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict[tuple[int, int], np.ndarray] = {}
            shared, size = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for i, (ax, bx, ay, by, tx, ty) in enumerate(zip(*(pdf[c] for c in (*PAIR, "tx", "ty")))):
                for key, t in (((ax, bx), tx), ((ay, by), ty)):
                    if key not in known:
                        known[key] = _set_of_text(t, gram)
                x, y = known[ax, bx], known[ay, by]
                shared[i] = len(np.intersect1d(x, y, assume_unique=True))
                size[i] = len(x) + len(y) - shared[i]
            own = pdf[PAIR].assign(shared=shared, union=size)
            yield own[own["shared"] >= threshold * own["union"] - 1e-9]

    side = lambda t, s: t.select(F.col("k1").alias("a" + s), F.col("k2").alias("b" + s), F.struct("title", "content").alias("t" + s))
    joined = pairs.join(side(x_texts, "x"), ["ax", "bx"]).join(side(y_texts, "y"), ["ay", "by"]).select(*PAIR, "tx", "ty")
    return joined.mapInPandas(overlap, "ax long, bx long, ay long, by long, shared long, union long")
