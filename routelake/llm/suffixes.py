"""Removal of byte strings that an earlier document holds, by longest previous factors; first copies stay.

A string of SPAN bytes can stand twice only around an anchor that both places choose alike: the least of the hashed
GRAM-byte strings in it. So only suffixes that start at or before anchors that several documents share are put in suffix
order, dealt by anchor, and every string of SPAN bytes is still judged exactly, by its bytes.

Blocks of documents pass four steps: (1) each sends its distinct anchors to buckets; (2) a bucket answers which of them
several documents hold; (3) a block sends the bytes around those, once per distinct surrounding, with its least doc_id; a
bucket makes a suffix array of its suffixes with common prefixes, capped at SPAN bytes, and from the previous and next
smaller documents in suffix order the longest previous factor of each suffix: where it reaches SPAN, an earlier document
holds those bytes; (4) a block marks what an earlier document holds. A string that a third of all documents share is one row
per block in each step. Anchors in very many blocks are dealt by the bytes after them, for suffixes that reach far behind
them, and once more by the bytes before them, for the others, so that one bucket doesn't get all that stands around a frequent
word. The blocked texts are shuffled once and read three times.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship, trim
from .parcels import HOT_BLOCKS, PARCEL, bucket_of, held_by_several, layout, mix, pack_names, parcels, squeeze, unpack_names, unsqueeze

GRAM = 20
#: Bytes of a block; more only in very large tables, see layout().
BLOCK_BYTES = 8_000_000
#: Bytes hashed at a time, so that they stay in a processor's cache; contexts put in suffix order at a time.
CHUNK, ORDERED = 1 << 17, 100_000
NO_DOC = np.iinfo(np.int64).max


def _least(a: np.ndarray, n: int) -> np.ndarray:
    """Least of a[i:i+n] at each i, as far as a goes."""
    out, w = a.copy(), 1
    while w < n:
        step = min(w, n - w)
        out[:-step] = np.minimum(out[:-step], out[step:])
        w += step
    return out


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int) -> np.ndarray:
    """Places of the anchors of documents that stand one after another in buf."""
    found = []
    lens = ends - starts
    first = 0
    while first < len(starts):
        last = first + 1
        while last < len(starts) and ends[last] - starts[first] <= CHUNK:
            last += 1
        lo, hi = int(starts[first]), int(ends[last - 1])
        if hi - lo >= span:
            left = np.repeat(ends[first:last], lens[first:last]) - np.arange(lo, hi)  # bytes to the document's end
            found.append(lo + _chosen(buf[lo:hi], left, span))
        first = last
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _chosen(text: np.ndarray, left: np.ndarray, span: int) -> np.ndarray:
    u = np.uint32
    powers = {1: text.astype(u) + u(1)}
    w = 1
    while 2 * w <= GRAM:
        h = powers[w].copy()
        h[:-w] = h[:-w] * u(pow(0x9E3779B1, w, 1 << 32)) + powers[w][w:]
        w *= 2
        powers[w] = h
    at, rest = w, GRAM - w
    h = powers[w].copy()
    while rest:
        w = 1 << (rest.bit_length() - 1)
        h[:-at] = h[:-at] * u(pow(0x9E3779B1, w, 1 << 32)) + powers[w][at:]
        at, rest = at + w, rest - w
    h ^= h >> u(15)
    h *= u(0x85EBCA6B)
    h ^= h >> u(13)
    h *= u(0xC2B2AE35)
    h ^= h >> u(16)
    h = np.clip(h, 1, 0xFFFFFFFE).astype(u)
    h[left < GRAM] = 0xFFFFFFFF
    n = span - GRAM + 1
    most = np.where(left >= span, _least(h, n), u(0))[::-1]  # of each string, its least hash; 0 where none starts
    most = ~_least(~most, n)[::-1]  # the largest of those of the strings that hold a place
    return np.flatnonzero(most == h)


def names(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """48-bit names of the GRAM-byte strings at these places."""
    out = np.empty(len(at), np.uint64)
    view = np.lib.stride_tricks.sliding_window_view(buf, GRAM)
    for a in range(0, len(at), 1 << 16):
        out[a : a + (1 << 16)] = mix(np.ascontiguousarray(view[at[a : a + (1 << 16)]]).view("<u4"))
    return out >> np.uint64(16)


class Block:
    """Texts of a block in one buffer, in a fixed order, with their anchors."""

    def __init__(self, table: pa.Table, span: int) -> None:
        rows = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        self.doc_ids = [d for d, _ in rows]
        self.docs = np.array([NO_DOC if d is None else d for d in self.doc_ids], np.int64)
        texts = [(t or "").encode("utf-8", "surrogatepass") for _, t in rows]
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lens)
        self.starts = self.ends - lens
        self.buf = np.frombuffer(b"".join(texts) + bytes(span), np.uint8)
        self.at = anchors(self.buf[: int(lens.sum())], self.starts, self.ends, span)
        self.of = np.searchsorted(self.ends, self.at, side="right")
        self.names = names(self.buf, self.at)
        self.span = span

    def surroundings(self, shared: np.ndarray) -> dict[str, np.ndarray]:
        """Distinct surroundings of anchors with these (sorted) names, in a fixed order, and which places have which."""
        wing = self.span - GRAM
        k = np.minimum(np.searchsorted(shared, self.names), max(0, len(shared) - 1))
        keep = np.flatnonzero(shared[k] == self.names) if len(shared) else np.zeros(0, np.int64)
        at, of, name = self.at[keep], self.of[keep], self.names[keep]
        before = np.minimum(wing, at - self.starts[of])
        after = np.minimum(wing, self.ends[of] - at - GRAM)
        width = 2 * wing + GRAM
        padded = np.concatenate([np.zeros(wing, np.uint8), self.buf, np.zeros(wing, np.uint8)])
        around = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, width)[at])
        place = np.arange(width)
        cut = np.flatnonzero((before < wing) | (after < wing))
        around[cut] *= (place >= (wing - before[cut])[:, None]) & (place < (wing + GRAM + after[cut])[:, None])
        group, first = same_rows(name, around, before, after)
        return {"at": at, "of": of, "group": group, "name": name[first], "around": around[first], "before": before[first], "after": after[first]}


def same_rows(name: np.ndarray, around: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers rows by equality of all four, in order of name; the first row of each number. Bytes are compared, not hashes."""
    if not len(name):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    short = -around.shape[1] % 4
    words = np.pad(around, ((0, 0), (0, short))) if short else around
    mixed = mix(np.column_stack([np.ascontiguousarray(words).view("<u4"), before.astype(np.uint32), after.astype(np.uint32)]))
    order = np.lexsort((mixed, name))
    a, b = order[1:], order[:-1]
    same = (name[a] == name[b]) & (mixed[a] == mixed[b])
    k = np.flatnonzero(same)
    same[k] = (around[a[k]] == around[b[k]]).all(1) & (before[a[k]] == before[b[k]]) & (after[a[k]] == after[b[k]])
    number = np.concatenate([[0], np.cumsum(~same)])
    group = np.empty(len(name), np.int64)
    group[order] = number
    return group, order[np.flatnonzero(np.concatenate([[True], ~same]))]


def smaller_before(doc: np.ndarray, lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every place in suffix order the previous one with a smaller document, and their common prefix; -1 and 0 where that
    is shorter than least.

    lcp: common prefix of a place and the one before. Links start at the place before and jump over each other: what stands
    between a place and its link is never smaller, so a link may take over that of the place it points to.
    """
    at, held = np.arange(len(doc)) - 1, lcp.astype(np.int64)
    open_ = held >= least
    if len(open_):
        open_[0] = False
    at[~open_], held[~open_] = -1, 0
    go = np.flatnonzero(open_)
    while len(go):
        go = go[doc[at[go]] >= doc[go]]
        hop = at[go]
        further, both = at[hop], np.minimum(held[go], held[hop])
        lost = (further < 0) | (both < least)
        at[go], held[go] = np.where(lost, -1, further), np.where(lost, 0, both)
        go = go[~lost]
    return at, held


def longest_previous(doc: np.ndarray, lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factors in suffix order: how many bytes of a suffix also start in an earlier document, and the place
    there; 0 and -1 where fewer than least. Of all earlier ones, the previous and the next smaller place are the most alike.
    """
    before, n_before = smaller_before(doc, lcp, least)
    after, n_after = smaller_before(doc[::-1], np.concatenate([lcp[:1], lcp[1:][::-1]]), least)
    after, n_after = after[::-1], n_after[::-1]
    after = np.where(after < 0, -1, len(doc) - 1 - after)
    return np.maximum(n_before, n_after), np.where(n_before >= n_after, before, after)


def common_prefixes(keys: list[np.ndarray], steps: list[int], span: int, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Equal bytes of each place in order and the one before, at most span; 0 across groups. keys: 8 bytes from each step on."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    a, b = order[1:], order[:-1]
    apart, step = np.zeros(len(a), np.uint64), np.full(len(a), span, np.int64)
    for key, at in zip(keys, steps, strict=True):
        new = key[a] ^ key[b]
        fresh = (apart == 0) & (new != 0)
        apart[fresh], step[fresh] = new[fresh], at
    equal = np.zeros(len(a), np.int64)
    for bits in range(8, 64, 8):
        equal += apart < np.uint64(1 << bits)
    out[1:] = np.where(group[a] != group[b], 0, np.where(apart == 0, span, step + equal))
    return out


def sides(span: int) -> np.ndarray:
    """Least and largest place before the anchor of suffixes: of all, of those dealt by the bytes after it, of the others."""
    wing = span - GRAM
    return np.array([[0, wing], [0, wing // 2], [wing // 2 + 1, wing]])


def first_holders(name: np.ndarray, around: np.ndarray, before: np.ndarray, after: np.ndarray, doc: np.ndarray, span: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per suffix in these surroundings, at the given least to largest places: its row, its place before the anchor, and a document with the same span bytes: an
    earlier one if there is any, else its own least.

    The suffix array holds suffixes by their first span bytes, equal ones by document. The answer is read from the longest
    previous factors: those of span bytes have an earlier document, which stands at the previous or next smaller place.
    """
    wing = span - GRAM
    words = np.lib.stride_tricks.sliding_window_view(around, 8, axis=1)
    steps = [*range(0, span - 7, 8), span - 8]
    rows, shifts, firsts = [], [], []
    bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])), [len(name)]])
    at = 0
    while at < len(bounds) - 1:
        upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + ORDERED, side="right")) - 1)
        lo, hi = int(bounds[at]), int(bounds[upto])
        at = upto
        held = lo + np.argsort(doc[lo:hi], kind="stable")  # sorting keeps this order among equal suffixes
        big = np.ascontiguousarray(words[held]).view(">u8")[:, :, 0].astype(np.uint64)
        shift = np.arange(wing + 1)
        ok = (shift <= before[held, None]) & (wing - shift <= after[held, None])
        row, s = np.nonzero(ok & (shift >= places[held, :1]) & (shift <= places[held, 1:]))
        keys = [big[row, wing - s + o] for o in steps]
        group = np.unique(name[held], return_inverse=True)[1][row]
        order = np.lexsort((*keys[::-1], group))
        lcp = common_prefixes(keys, steps, span, order, group)
        own = doc[held[row[order]]]
        factor, holder = longest_previous(own, lcp, span)
        who = np.empty(len(order), np.int64)
        who[order] = np.where(factor >= span, own[holder], own)
        rows.append(held[row])
        shifts.append(s)
        firsts.append(who)
    rows, shifts, firsts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, shifts, firsts))
    by = np.argsort(rows, kind="stable")
    return rows[by], shifts[by], firsts[by]


def remove_earlier(docs: DataFrame, span: int = 50, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """Removes every byte that a string of span bytes covers which also starts in a document with a smaller doc_id.

    docs: doc_id, text; other columns are ignored. Result: doc_id, n_bytes, spans (array of start, end: the removed
    runs of UTF-8 bytes), kept (the remaining bytes). Matches never cross documents, and texts are judged as they came.
    Null text: empty. Null doc_ids stand after all others; equal doc_ids, null ones too, don't remove from each other.
    No rows: no rows. What stands around anchors in hot_blocks blocks or more is dealt by more bytes than theirs.
    """
    if span < GRAM + 1:
        raise ValueError(f"span must be above {GRAM}")
    spark = docs.sparkSession
    ship(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n_blocks, buckets = layout(spark, total, BLOCK_BYTES)
    blocked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"))

    def offer(table: pa.Table) -> pa.Table:
        trim()
        block = Block(table, span)
        order = np.lexsort((block.docs[block.of], block.names))
        name, doc = block.names[order], block.docs[block.of[order]]
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(name))[: len(first)] - 1
        several, name = doc[first] != doc[last], name[first]
        cut = np.searchsorted(bucket_of(name, buckets), np.arange(buckets + 1))
        parts = [(k, a, b) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
        return parcels([k for k, _, _ in parts], [table["block"][0].as_py()] * len(parts), [squeeze(pack_names(name[a:b]), np.packbits(several[a:b])) for _, a, b in parts])

    def ask(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        trim()
        if not docs_.num_rows or not answers.num_rows:
            return parcels([], [], [])
        block = Block(docs_, span)
        shared, hot = _answered(answers["payload"].to_pylist())
        held = block.surroundings(shared)
        least, most = _ends(block, held)
        is_hot = hot[np.searchsorted(shared, held["name"])]
        wing, to, payload = span - GRAM, [], []
        for side, chosen in ((0, ~is_hot), (1, is_hot & (held["after"] >= wing - wing // 2)), (2, is_hot & (held["before"] > wing // 2))):
            at = np.flatnonzero(chosen)
            name = held["name"][at]
            if side:  # dealt by the anchor and the bytes that all suffixes of this side hold
                context = held["around"][at, wing + GRAM : 2 * wing + GRAM - wing // 2] if side == 1 else held["around"][at, wing - wing // 2 - 1 : wing]
                name = mix(np.column_stack([name, name >> np.uint64(24), context])) >> np.uint64(16)
                by = np.argsort(name, kind="stable")
                name, at = name[by], at[by]
            cut = np.searchsorted(bucket_of(name, buckets), np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cut)).tolist():
                part = at[cut[k] : cut[k + 1]]
                to.append(k)
                payload.append(squeeze(np.array([side]), np.diff(part, prepend=0).astype(np.int32), pack_names(name[cut[k] : cut[k + 1]]),
                    held["around"][part], held["before"][part].astype(np.uint8), held["after"][part].astype(np.uint8), least[part], most[part]))
        return parcels(to, [docs_["block"][0].as_py()] * len(to), payload)

    def _answered(answers: list) -> tuple[np.ndarray, np.ndarray]:
        """The sorted names that several documents hold, and which of them are hot."""
        found = [unsqueeze(p) for p in answers]
        names_ = [unpack_names(f[0]) for f in found]
        hot = [np.unpackbits(f[1], count=len(n)).astype(bool) for f, n in zip(found, names_, strict=True)]
        every, first = np.unique(np.concatenate(names_), return_index=True)
        return every, np.concatenate(hot)[first]

    def _ends(block: Block, held: dict) -> tuple[np.ndarray, np.ndarray]:
        doc, n = block.docs[held["of"]], len(held["name"])
        least, most = np.full(n, NO_DOC), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(least, held["group"], doc)
        np.maximum.at(most, held["group"], doc)
        return least, most

    def order(table: pa.Table) -> pa.Table:
        trim()
        origin, found = table["origin"].to_pylist(), [unsqueeze(p) for p in table["payload"].to_pylist()]
        sizes = [len(f[1]) for f in found]
        side = np.repeat([f[0][0] for f in found], sizes)
        offset = np.concatenate([np.cumsum(f[1]) for f in found])
        sender = np.repeat(np.arange(len(found)), sizes)
        # Names of different sides are told apart by two bits.
        name = np.concatenate([unpack_names(f[2]) for f in found]) << np.uint64(2) | side.astype(np.uint64)
        around = np.concatenate([f[3] for f in found])
        before, after = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in (4, 5))
        least, most = (np.concatenate([f[k] for f in found]) for k in (6, 7))
        group, first = same_rows(name, around, before, after)
        places = sides(span)[side[first]]
        doc = np.full(len(first), NO_DOC)
        np.minimum.at(doc, group, least)
        # A surrounding that is alone at its anchor needs no order: all of its strings start first in its least document.
        first_name = name[first]
        new = np.concatenate([[True], first_name[1:] != first_name[:-1]])
        run = np.cumsum(new) - 1
        alone = np.bincount(run)[run] == 1
        several = np.flatnonzero(~alone)
        row, shift, holder = first_holders(first_name[several], around[first[several]], before[first[several]], after[first[several]], doc[several], span, places[several])
        lone = np.flatnonzero(alone)
        wing = span - GRAM
        # Runs of shifts with one holder: (number, from, to, holder).
        start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (holder[1:] != holder[:-1])])) if len(row) else np.zeros(0, np.int64)
        end = np.append(start[1:], len(row))[: len(start)] - 1
        number = np.concatenate([lone, several[row[start]]]).astype(np.int64)
        lo = np.concatenate([np.maximum(places[lone, 0], wing - after[first[lone]]), shift[start]])
        hi = np.concatenate([np.minimum(places[lone, 1], before[first[lone]]), shift[end]])
        who = np.concatenate([doc[lone], holder[start]])
        by = np.argsort(number, kind="stable")
        number, lo, hi, who = number[by], lo[by], hi[by], who[by]
        at, n = np.searchsorted(number, np.arange(len(first))), np.bincount(number, minlength=len(first))
        count = n[group]
        ends = np.cumsum(count)
        pick = np.repeat(at[group] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)
        member = np.repeat(np.arange(len(group)), count)
        useful = (who[pick] < most[member]) & (lo[pick] <= hi[pick])
        pick, member = pick[useful], member[useful]
        cuts = np.searchsorted(sender[member], np.arange(len(found) + 1))
        answers = [squeeze(offset[member[a:b]].astype(np.int32), lo[pick[a:b]].astype(np.uint8), hi[pick[a:b]].astype(np.uint8), who[pick[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return parcels(origin, table["to"].to_pylist(), answers)

    def cut(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        trim()
        if not docs_.num_rows:
            return pa.table({k: [] for k in ("doc_id", "n_bytes", "spans", "kept")}, OUT)
        block = Block(docs_, span)
        payloads = [(unsqueeze(p), o) for p, o, kind in zip(answers["payload"].to_pylist(), answers["origin"].to_pylist(), answers["kind"].to_pylist(), strict=True) if kind == 1]
        marks = np.zeros(len(block.buf) + 1, np.int32)
        if payloads:
            shared, _ = _answered([p for p, kind in zip(answers["payload"].to_pylist(), answers["kind"].to_pylist(), strict=True) if kind == 0])
            held = block.surroundings(shared)
            by = np.argsort(held["group"], kind="stable")
            n_groups = len(held["name"])
            at, n = np.searchsorted(held["group"][by], np.arange(n_groups)), np.bincount(held["group"], minlength=n_groups)
            for (number, lo, hi, who), _ in payloads:
                count = n[number]
                ends = np.cumsum(count)
                place = by[np.repeat(at[number] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]
                lo, hi, who = (np.repeat(x, count) for x in (lo.astype(np.int64), hi.astype(np.int64), who))
                later = block.docs[held["of"][place]] > who
                where = held["at"][place[later]]
                np.add.at(marks, where - hi[later], 1)
                np.add.at(marks, where - lo[later] + span, -1)
        gone = np.cumsum(marks[:-1]) > 0
        return _result(block, gone)

    both = lambda first, second: first.withColumn("kind", F.lit(0)).unionByName(second.withColumn("kind", F.lit(1)))
    by_block = lambda df: df.groupBy("block")
    offers = by_block(blocked).applyInArrow(offer, PARCEL)
    answers = offers.groupBy("to").applyInArrow(held_by_several(hot_blocks), PARCEL)
    asks = by_block(blocked).cogroup(answers.groupBy("to")).applyInArrow(ask, PARCEL)
    orders = asks.groupBy("to").applyInArrow(order, PARCEL)
    return by_block(blocked).cogroup(both(answers, orders).groupBy("to")).applyInArrow(cut, OUT_SQL)


OUT_SQL = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _result(block: Block, gone: np.ndarray) -> pa.Table:
    edges = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
    inside = np.zeros(len(gone) + 1, bool)
    inside[block.starts] = True  # a run that meets a document's start begins anew there
    begin = np.flatnonzero((edges == 1) | (inside & np.append(gone, False)))
    stop = np.flatnonzero((edges == -1) | (inside & np.concatenate([[False], gone])))
    doc = np.searchsorted(block.ends, begin, side="right")
    n = np.bincount(doc, minlength=len(block.docs))
    bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(begin - block.starts[doc]), pa.array(stop - block.starts[doc])], ["start", "end"])
    kept = [block.buf[a:b][~gone[a:b]].tobytes() if c else block.buf[a:b].tobytes() for a, b, c in zip(block.starts.tolist(), block.ends.tolist(), n.tolist(), strict=True)]
    return pa.table([pa.array(block.doc_ids, pa.int64()), pa.array(block.ends - block.starts), pa.ListArray.from_arrays(pa.array(bounds), pairs), pa.array(kept, pa.binary())], schema=OUT)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return remove_earlier(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every string of 50 bytes with its least document; places are walked in pieces of 300, as engines cut long strings slowly.
ORACLE = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS MATERIALIZED (SELECT rid, doc_id, o, substring(h, 2 * o + 1, 698) AS h FROM (SELECT *, unnest(range(0, len(h) // 2, 300)) AS o FROM d)),
w AS MATERIALIZED (
  SELECT rid, doc_id, o + i AS i, substring(h, 2 * i + 1, 100) AS g
  FROM (SELECT *, unnest(range(0, least(300, len(h) // 2 - 49))) AS i FROM p WHERE len(h) >= 100)),
first AS MATERIALIZED (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT rid, i, i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 50 IS NOT FALSE AS fresh FROM w JOIN first USING (g) WHERE doc_id > least),
runs AS (SELECT rid, min(i) AS a, max(i) + 50 AS b FROM (SELECT rid, i, sum(fresh::INT) OVER (PARTITION BY rid ORDER BY i) AS r FROM gone) GROUP BY rid, r),
per AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS las, list(b ORDER BY a) AS lbs FROM runs GROUP BY rid),
parts AS (
  SELECT d.*, n_removed, n_spans,
    list_transform(range(0, coalesce(len(las), 0) + 1), lambda k: substring(h, 2 * coalesce(lbs[k], 0) + 1, 2 * (coalesce(las[k + 1], len(h) // 2) - coalesce(lbs[k], 0)))) AS kept
  FROM d LEFT JOIN per USING (rid))
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(array_to_string(kept, ''))) AS kept_sha256
FROM parts
"""
