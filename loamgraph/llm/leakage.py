"""Passages of evaluation items that stand in training documents.

Both sides become letter streams, so case, punctuation, hyphens and broken words
do not matter. Rare n-grams of an item are the seeds that join documents to items;
each line of a joined document is then aligned to the item by Smith-Waterman in a
band around its best diagonal, and aligned lines that continue each other in the
item are chained over whatever lines stand between them.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.letters import GramSet, grams, letters, slices, words_of
from loamgraph.runtime import table

#: Letters of a seed and of the finer grams that find a line's diagonal.
SEED, FINE = 10, 6
#: Items that are searched for at a time; more are taken in blocks of as many.
BLOCK_ITEMS = 5_000
#: Letters of the items of a block (100 MB of tables); a longer item is a block of its own.
BLOCK_LETTERS = 2_000_000
#: Letters of documents that are aligned at a time, each counted once a pair (about 150 bytes of memory a letter).
PAIR_LETTERS = 1_000_000
#: Numbers up to which pairs of documents and items are tallied in one array (8 bytes each); beyond, they are only sorted.
MAX_TALLY = 20_000_000
#: Lines that are compared at a time to find those that bridge others (about 2 KB each).
BRIDGE_ROWS = 20_000


@dataclass(frozen=True)
class LeakRules:
    min_words: int = 20
    shared_opening: int = 3  # an opening sentence of as many items is an instruction
    rare_share: float = 0.005  # a seed is rare if at most this share of documents has it
    rare_least: int = 3  # ... or as few documents as this
    block: int = 60  # letters of an item of which ...
    per_block: int = 12  # ... the rarest so many seeds are kept, however frequent
    # A document is joined to an item by a run of min_words of its words ...
    gram_share: float = 0.5  # of whose n-grams it has this share, rare or not
    mixed_share: float = 0.35  # ... or this share,
    min_seeds: int = 15  # or as many seeds,
    seed_share: float = 0.3  # and in either case this share of the seeds there
    line_grams: int = 4  # fine grams on one diagonal for which a line is aligned
    pair_grams: int = 30  # ... and all lines of a pair together, or it is dropped
    band: int = 4
    mismatch: int = 3
    piece: int = 64  # letters at which a line is cut for alignment


class Items:
    """The items of a block as letter streams, without their shared openings."""

    def __init__(self, ids: list[int], texts: list[str], rules: LeakRules, openings: set[str] | None = None):
        openings = shared_openings(texts, rules) if openings is None else openings
        bodies = [_without(t, openings) for t in texts]
        kept = [(i, w) for i, b in zip(ids, bodies) if len(w := words_of(b)) >= rules.min_words]
        self.ids = np.array([i for i, _ in kept], np.int64)
        words = [w for _, w in kept]
        # One "text" a word, so that owners give the letters of each word.
        flat = [w for ws in words for w in ws]
        self.code, word, _ = letters(flat) if flat else (np.zeros(0, np.uint8), np.zeros(0, np.int64), None)
        item_of_word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        self.owner = item_of_word[word] if len(word) else np.zeros(0, np.int64)
        self.start = np.searchsorted(self.owner, np.arange(len(kept) + 1))
        begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        self.word_at = begin  # first letter of each word, over all items
        self.seed = grams(self.code, self.owner, SEED)
        fine = grams(self.code, self.owner, FINE)
        at = np.flatnonzero(fine >= 0)
        key = (self.owner[at].astype(np.int64) << 36) | fine[at]
        order = np.argsort(key, kind="stable")
        self.fine_at = at[order]
        self.fine_key, self.fine_first, self.fine_n = np.unique(key[order], return_index=True, return_counts=True)
        self.fine = GramSet(self.fine_key)
        self._count_words()

    def window(self, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """For each letter, the run of ``n_words`` whole words of its item that begins with its word, or ends with the item."""
        word = np.searchsorted(self.word_at, np.arange(len(self.code)), side="right") - 1
        last = np.searchsorted(self.word_at, self.start[self.owner + 1])
        first = np.minimum(word, last - n_words)
        edge = np.append(self.word_at, len(self.code))
        return edge[first], edge[first + n_words]

    def _count_words(self) -> None:
        """For each place of each item, the words that begin at or after it and end at or before it, up to a few letters."""
        n = len(self.code)
        last = np.append(self.word_at[1:], n)
        slack = np.minimum(4, (last - self.word_at) // 3)
        item = self.owner[self.word_at] if n else np.zeros(0, np.int64)
        # An item's places stand apart by one, as it has one more of them than letters.
        size = n + len(self.ids) + 1
        after = np.bincount(np.minimum(self.word_at + slack, last) + item, minlength=size)
        until = np.bincount(last - slack + item, minlength=size)
        begin = self.start[:-1] + np.arange(len(self.ids))
        total = np.bincount(item, minlength=len(self.ids))
        cut = np.cumsum(after) - after
        self.not_before = np.repeat(total, np.diff(self.start) + 1) - (cut[:-1] - np.repeat(cut[begin], np.diff(self.start) + 1))
        done = np.cumsum(until)
        self.not_after = done[:-1] - np.repeat(done[begin] - until[begin], np.diff(self.start) + 1)
        self.n_words = total

    def words_in(self, item: int, a: int, b: int) -> int:
        """Words of an item that its letters a..b cover, up to a few letters at either end."""
        begin = self.start[item] + item
        return max(0, int(self.not_before[begin + a] + self.not_after[begin + b] - self.n_words[item]))

    def words_between(self, item: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``words_in`` of several stretches of one item."""
        begin = self.start[item] + item
        return self.not_before[begin + a] + self.not_after[begin + b] - self.n_words[item]


def shared_openings(texts: list[str], rules: LeakRules) -> set[str]:
    """Opening sentences, and what follows them, that several items have in common."""
    out: set[str] = set()
    rest = [t.strip() for t in texts]
    while True:
        count = Counter(_opening(t) for t in rest if t)
        new = {s for s, n in count.items() if s and n >= rules.shared_opening}
        if not new:
            return out
        out |= new
        rest = [t[len(s) :].strip() if (s := _opening(t)) in new else "" for t in rest]


def _opening(text: str) -> str:
    m = re.match(r".*?(?:[.?!:](?=\s|$)|[。？！])", text, re.S)
    return m.group() if m else ""


def _without(text: str, openings: set[str]) -> str:
    text = text.strip()
    while (s := _opening(text)) and s in openings:
        text = text[len(s) :].strip()
    return text


def pick_seeds(items: Items, values: np.ndarray, df: np.ndarray, n_docs: int, rules: LeakRules) -> np.ndarray:
    """The seeds of the items: rare n-grams, and in each block of an item its rarest whatever they are."""
    at = np.flatnonzero(items.seed >= 0)
    f = df[np.searchsorted(values, items.seed[at])]
    rare = f <= max(rules.rare_least, rules.rare_share * n_docs)
    block = items.owner[at].astype(np.int64) * (len(items.code) // rules.block + 1) + (at - items.start[items.owner[at]]) // rules.block
    order = np.lexsort((f, block))
    place = np.arange(len(order)) - np.searchsorted(block[order], block[order], side="left")
    rare[order[place < rules.per_block]] = True
    return np.unique(items.seed[at[rare]])


def find_leaks(doc_ids: np.ndarray, texts: list[str], items: Items, known: GramSet, places: Places, rules: LeakRules) -> list[tuple[int, int, int]]:
    """(doc_id, item_id, words): the longest run of each pair that is long enough; ``known`` are all n-grams of the items."""
    if not len(texts) or not len(items.ids):
        return []
    code, owner, line = letters(texts)
    g = grams(code, owner, SEED)
    at, j = known.hits(g)
    if not len(at):
        return []
    docs, its = _candidates(at, j, owner, items, known, places, rules)
    out = []
    # So many pairs at a time that their lines have about PAIR_LETTERS letters.
    run = np.cumsum(np.bincount(owner, minlength=len(texts))[docs]) // PAIR_LETTERS
    for k in np.unique(run):
        doc_of, item_of = docs[run == k], its[run == k]
        tasks = _diagonals(code, owner, line, items, doc_of, item_of, rules)
        segments = _align(code, items, tasks, rules)
        out += [(int(doc_ids[doc_of[c]]), int(items.ids[item_of[c]]), w) for c, w in _chains(code, line, items, item_of, segments, rules) if w >= rules.min_words]
    return out


def _expand(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each of ``count`` copies, and which copy it is."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted different numbers; for millions of them sorting is faster than the hashing of ``np.unique``."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


class Places:
    """Where the items' n-grams stand, and what is asked of the run of words at each place; made once for all documents."""

    def __init__(self, items: Items, known: GramSet, seeds: np.ndarray, rules: LeakRules):
        place = np.flatnonzero(items.seed >= 0)
        order = np.argsort(items.seed[place], kind="stable")
        gram, self.place = items.seed[place][order], place[order]
        self.lo, self.hi = np.searchsorted(gram, known.values), np.searchsorted(gram, known.values, side="right")
        self.is_seed = np.isin(known.values, seeds)
        self.first, end = items.window(rules.min_words)
        self.last = np.maximum(end - SEED + 1, self.first + 1)
        seed_at = np.sort(self.place[np.isin(gram, seeds)])
        self.seeds_there = np.searchsorted(seed_at, self.last) - np.searchsorted(seed_at, self.first)
        # Fewer places than this satisfy no rule.
        self.need = min(rules.min_seeds, rules.mixed_share * (self.last - self.first).min(initial=1 << 30))


def _candidates(at, j, owner, items: Items, known: GramSet, places: Places, rules: LeakRules):
    """Pairs of document and item with enough seeds, or enough of all n-grams, of some run of words, wherever they stand in the document."""
    n_items, n_grams, n_letters = len(items.ids), len(known.values), len(items.code)
    once = _distinct(owner[at].astype(np.int64) * n_grams + j)
    doc, j = once // n_grams, once % n_grams
    row, k = _expand(places.hi[j] - places.lo[j])
    where = places.place[places.lo[j[row]] + k]
    # Pairs with too few places are left out before the places are sorted.
    pair = doc[row] * n_items + items.owner[where]
    if len(pair) and int(pair.max()) < MAX_TALLY:
        some = np.flatnonzero(np.bincount(pair)[pair] >= places.need)
        row, where = row[some], where[some]
    # N-grams found in the run of words at each place that was found: all of them, and the seeds among them.
    key = doc[row] * n_letters + where
    seed = np.sort(key[places.is_seed[j[row]]])
    key = np.sort(key)
    at = key % n_letters
    first, last = key - at + places.first[at], key - at + places.last[at]
    n_seeds = np.searchsorted(seed, last) - np.searchsorted(seed, first)
    share = (np.searchsorted(key, last) - np.searchsorted(key, first)) / (last - first)
    good = (share >= rules.gram_share) | ((share >= rules.mixed_share) | (n_seeds >= rules.min_seeds)) & (n_seeds >= rules.seed_share * places.seeds_there[at])
    pair = _distinct((key // n_letters * n_items + items.owner[at])[good])
    return pair // n_items, pair % n_items


@dataclass
class Tasks:
    cand: np.ndarray
    piece: np.ndarray  # number of the piece of a line, in reading order
    line: np.ndarray
    begin: np.ndarray  # first letter of the piece
    size: np.ndarray
    shift: np.ndarray  # item letter that stands against the piece's first letter
    item_begin: np.ndarray
    item_end: np.ndarray
    pieces: dict


def _pieces(line: np.ndarray, owner: np.ndarray, size: int):
    """Lines cut into pieces of at most ``size`` letters: first letter and length of each."""
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(line)))
    row, k = _expand((length + size - 1) // size)
    begin = start[row] + k * size
    return begin, np.minimum(size, start[row] + length[row] - begin)


def _diagonals(code, owner, line, items: Items, doc_of, item_of, rules: LeakRules) -> Tasks:
    """For each piece of a line of a pair's document, the two diagonals that most fine grams agree on."""
    begin, size = _pieces(line, owner, rules.piece)
    piece_line, piece_doc = line[begin], owner[begin]
    lo, hi = np.searchsorted(piece_doc, doc_of), np.searchsorted(piece_doc, doc_of, side="right")
    cand, k = _expand(hi - lo)
    piece = lo[cand] + k
    fine = grams(code, owner, FINE)
    row, i = _expand(np.maximum(0, size[piece] - FINE + 1))
    pos = begin[piece[row]] + i
    key = (item_of[cand[row]].astype(np.int64) << 36) | np.where(fine[pos] >= 0, fine[pos], (1 << 36) - 1)
    known, which = items.fine.hits(key)
    hit, m = _expand(items.fine_n[which])
    item_pos = items.fine_at[items.fine_first[which[hit]] + m]
    hit = known[hit]
    item_pos = item_pos - items.start[item_of[cand[row[hit]]]]
    shift = item_pos - i[hit]
    # Shifts lie between minus the letters of a piece and the letters of an item.
    stride = int(np.diff(items.start).max()) + 2 * rules.piece + 2
    group = row[hit].astype(np.int64) * stride + shift + rules.piece
    group = np.sort(group)
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    values, counts = group[begins], np.diff(np.append(begins, len(group)))
    of = values // stride
    # Shifts next to each other are one diagonal with a letter more or less.
    near = counts.copy()
    beside = values[1:] == values[:-1] + 1
    near[:-1] += np.where(beside, counts[1:], 0)
    near[1:] += np.where(beside, counts[:-1], 0)
    order = np.lexsort((-counts, -near, of))
    of, shift_sorted, near = of[order], values[order] % stride - rules.piece, near[order]
    heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    head = np.repeat(heads, np.diff(np.append(heads, len(of))))
    rank = np.arange(len(of)) - head
    best = shift_sorted[head]
    other = (rank > 0) & (np.abs(shift_sorted - best) > rules.band)
    # Of the diagonals away from the best one, the first.
    first_other = np.zeros(len(of), bool)
    idx = np.flatnonzero(other)
    if len(idx):
        first_other[idx[np.concatenate([[True], of[idx][1:] != of[idx][:-1]])]] = True
    take = ((rank == 0) | first_other) & (near >= rules.line_grams)
    total = np.bincount(cand[of[take & (rank == 0)]], weights=near[take & (rank == 0)], minlength=len(doc_of))
    take &= total[cand[of]] >= rules.pair_grams
    r = of[take]
    item = item_of[cand[r]]
    return Tasks(cand[r], piece[r], piece_line[piece[r]], begin[piece[r]], size[piece[r]], shift_sorted[take], items.start[item], items.start[item + 1], {"begin": begin, "size": size, "lo": lo, "hi": hi, "line": piece_line})


def _align(code, items: Items, t: Tasks, rules: LeakRules) -> dict:
    """Banded Smith-Waterman of all tasks at once: score and both intervals of each best local alignment.

    Score and place of origin (row and place in the band) are packed in one number,
    so the greatest carries its origin along.
    """
    n, width = len(t.cand), 2 * rules.band + 1
    bits = (rules.piece - 1).bit_length()
    unit = np.int32(1 << (bits + width.bit_length()))
    loss = np.int32(rules.mismatch) * unit
    best = np.zeros(n, np.int32)
    end_i, end_j = np.zeros(n, np.int64), np.zeros(n, np.int64)
    rows = int(t.size.max()) if n else 0
    h = np.zeros((n, width), np.int32)
    band = np.arange(width) - rules.band
    first = (t.item_begin + t.shift)[:, None] + band[None, :]  # letter of the item against each document letter 0
    low, high = t.item_begin[:, None], t.item_end[:, None]
    live = np.arange(n)
    for i in range(rows):
        live = live[t.size[live] > i]
        if not len(live):
            break
        at = first[live] + i
        ok = (at >= low[live]) & (at < high[live])
        same = ok & (items.code[np.clip(at, 0, len(items.code) - 1)] == code[t.begin[live] + i][:, None])
        origin = ((i << width.bit_length()) | np.arange(width)).astype(np.int32)
        prev = h[live]
        cur = np.where(same, np.maximum(prev, origin) + unit, np.where(prev >= loss, prev - loss, 0))
        # A letter of the document that the item lacks, then letters of the item that the document lacks.
        np.maximum(cur[:, :-1], np.where(prev[:, 1:] >= loss, prev[:, 1:] - loss, 0), out=cur[:, :-1])
        for _ in range(2):
            left = np.where(cur[:, :-1] >= loss, cur[:, :-1] - loss, 0)
            cur[:, 1:] = np.maximum(cur[:, 1:], left)
        cur = np.where(ok & (cur >= unit), cur, 0)
        h[live] = cur
        top = cur.argmax(axis=1)
        value = cur[np.arange(len(live)), top]
        better = value // unit > best[live] // unit
        w = live[better]
        best[w], end_i[w], end_j[w] = value[better], i + 1, (t.shift[live] + i)[better] + band[top[better]] + 1
    begin_i = ((best % unit) >> width.bit_length()).astype(np.int64)
    begin_j = t.shift + begin_i + (best & ((1 << width.bit_length()) - 1)) - rules.band
    return {"cand": t.cand, "piece": t.piece, "line": t.line, "score": (best // unit).astype(np.int64), "i0": begin_i, "i1": end_i, "j0": begin_j, "j1": end_j, "size": t.size, "pieces": t.pieces}


def _chains(code, line, items: Items, item_of, s: dict, rules: LeakRules):
    """(pair, words of its longest chain) of lines that continue each other in the item."""
    keep = np.flatnonzero(s["score"] >= 6)
    total = np.bincount(s["cand"][keep], weights=s["score"][keep], minlength=len(item_of))
    keep = keep[total[s["cand"][keep]] >= 2 * rules.min_words]
    order = keep[np.lexsort((s["piece"][keep], s["j0"][keep], s["cand"][keep]))]
    cand = s["cand"][order]
    if not len(cand):
        return
    p = s["pieces"]
    col = {k: s[k][order] for k in ("piece", "line", "i0", "i1", "j0", "j1", "size")}
    bounds = np.flatnonzero(np.concatenate([[True], cand[1:] != cand[:-1]]))
    pairs = []
    for a, b in zip(bounds, np.append(bounds[1:], len(cand))):
        item = int(item_of[cand[a]])
        pairs.append((int(cand[a]), item, {k: v[a:b] for k, v in col.items()}, *_links(items, item, {k: v[a:b] for k, v in col.items()}, rules)))
    # Lines to bridge are sought for all pairs at once.
    bridges = _bridged(code, items, p, *(np.concatenate([m[k] for _, _, _, _, m in pairs]) for k in ("item", "x", "y", "a", "b")))
    at = 0
    for pair, item, segments, joined, maybe in pairs:
        via = bridges[at : at + len(maybe["x"])]
        at += len(via)
        best = _longest(code, items, item, p, segments, joined, maybe, via, rules)
        if best >= rules.min_words:
            yield pair, best


def _longest(code, items: Items, item: int, p: dict, segments: dict, joined: list, maybe: dict, via: np.ndarray, rules: LeakRules) -> int:
    """Words of the longest chain of a pair's segments, or of the first found that is long enough."""
    piece, i0, i1, j0, j1 = (segments[k].tolist() for k in ("piece", "i0", "i1", "j0", "j1"))
    links = _passable(items, item, j0, j1, joined, maybe, via.tolist(), rules)
    best, tried = 0, set()
    for upwards, nearest in ((False, False), (False, True), (True, True), (True, False)):
        if best >= rules.min_words:
            break
        start, link = _join(links, j0, upwards, nearest)
        for y in sorted(range(len(piece)), key=lambda y: start[y] - j1[y]):
            if items.words_in(item, start[y], j1[y]) < max(rules.min_words, best + 1):
                break
            chain = _members(y, link, piece)
            if tuple(chain) not in tried:
                tried.add(tuple(chain))
                best = max(best, _verified(code, items, item, p, chain, i0, i1, start[y], j1[y], rules))
    return best


def _links(items: Items, item: int, s: dict, rules: LeakRules) -> tuple[list[tuple[int, int, int]], dict]:
    """(from, to, lines between) of segments that continue each other, in order of the item; and those that may over a bridged line.

    Lines above, where a column begins anew, have negative distances, however far
    they are. A line is bridged only where a chain could have enough words if every
    link held.
    """
    piece, ln, i0, i1, j0, j1 = (s[k] for k in ("piece", "line", "i0", "i1", "j0", "j1"))
    tail = s["size"] - i1
    gap, cut = j0[None, :] - j1[:, None], tail[:, None] + i0[None, :]
    lines, pieces = ln[None, :] - ln[:, None], piece[None, :] - piece[:, None]
    down = (lines > 0) | ((lines == 0) & (pieces > 0))
    rising = j0[:, None] < j0[None, :]
    joined = rising & (down | (lines < 0)) & (cut <= 10) & (np.abs(gap - cut) <= 3) & (gap >= -3)
    maybe = rising & down & ~joined & (tail[:, None] <= 5) & (i0[None, :] <= 5) & (gap > 0) & (gap <= 2 * rules.piece) & (pieces > 1)
    sure = np.argwhere(joined)
    out = list(zip(sure[:, 0].tolist(), sure[:, 1].tolist(), lines[joined].tolist()))
    open_ = np.argwhere(maybe)
    if len(open_):
        start, end = j0.tolist(), j1.tolist()
        both = np.concatenate([sure, open_])
        both = both[np.lexsort((both[:, 1], both[:, 0], j0[both[:, 0]]))].tolist()
        for x, y in reversed(both):
            end[x] = max(end[x], end[y])
        for x, y in both:
            start[y] = min(start[y], start[x])
        first, last = np.array(start)[open_[:, 0]], np.array(end)[open_[:, 1]]
        open_ = open_[items.words_between(item, first, last) >= rules.min_words]
    x, y = open_[:, 0], open_[:, 1]
    return out, {"item": np.full(len(x), item), "x": piece[x], "y": piece[y], "a": j1[x] + tail[x], "b": j0[y] - i0[y], "from": x, "to": y, "lines": lines[x, y]}


def _passable(items: Items, item: int, j0: list, j1: list, joined: list, maybe: dict, via: list, rules: LeakRules) -> list[tuple[int, int, int, int]]:
    """(from, to, bridged line or -1, lines between), by where they lead: joined segments, and those that a line bridges in a chain that can have enough words."""
    over = list(zip(maybe["from"].tolist(), maybe["to"].tolist(), via, maybe["lines"].tolist()))
    links = [(j0[x], x, y, False, -1, n) for x, y, n in joined] + [(j0[x], x, y, True, v, n) for x, y, v, n in over if v >= 0]
    every = [(j0[x], x, y) for x, y, _ in joined] + [(j0[x], x, y) for x, y, _, _ in over]
    start, end, out = list(j0), list(j1), []
    for _, x, y in sorted(every, reverse=True):
        end[x] = max(end[x], end[y])
    for _, x, y, bridged, v, n in sorted(links):  # all links to x come before those from it
        if bridged and items.words_in(item, start[x], end[y]) < rules.min_words:
            continue
        out.append((x, y, v, n))
        start[y] = min(start[y], start[x])
    return sorted(out, key=lambda v: (v[1], v[0]))


def _join(links, j0, upwards: bool, nearest: bool) -> tuple[list[int], list]:
    """Where each segment's chain begins, and the segment (and bridged line) before it.

    Of several segments that another may continue, it continues the one that began
    first, or with ``nearest`` the one whose line is nearest.
    """
    start, link, away = list(j0), [None] * len(j0), [1 << 30] * len(j0)
    for x, y, via, lines in links:
        if lines < 0 and not upwards:
            continue
        if abs(lines) < away[y] if nearest else start[x] < start[y]:
            start[y], link[y], away[y] = start[x], (x, via), abs(lines)
    return start, link


def _members(y: int, link: list, piece: list[int]) -> list[tuple[int, int]]:
    """(segment, piece) of the chain that ends at y, in reading order; a bridged line has no segment."""
    out = [(y, piece[y])]
    while link[y] is not None:
        y, via = link[y]
        if via >= 0:
            out.append((-1, via))
        out.append((y, piece[y]))
    return out[::-1]


def _verified(code, items: Items, item: int, p: dict, chain: list[int], i0, i1, a: int, b: int, rules: LeakRules) -> int:
    """Words of the longest stretch of item letters a..b whose every word the chain's lines hold.

    The lines' letters are aligned to the item once more as a whole and each word
    is given its misread letters: one, or two neighbours read for one.
    """
    parts, edge = [], 8
    for k, (seg, number) in enumerate(chain):
        size = int(p["size"][number])
        lo = max(0, i0[seg] - edge) if k == 0 else 0
        hi = min(size, i1[seg] + edge) if k + 1 == len(chain) else size
        parts.append(code[p["begin"][number] + lo : p["begin"][number] + hi])
    base, top = items.start[item], items.start[item + 1]
    lo, hi = max(base, base + a - edge), min(top, base + b + edge)
    wrong = _letter_errors(np.concatenate(parts), items.code[lo:hi])
    w0, w1 = np.searchsorted(items.word_at, [lo, hi])
    best = run = 0
    for w in range(w0, w1):
        first = items.word_at[w]
        last = min(items.word_at[w + 1], top) if w + 1 < len(items.word_at) else top
        size = last - first
        if last <= hi and wrong[first - lo : last - lo].sum() <= (1 if size < 3 else 2) and size > wrong[first - lo : last - lo].sum():
            run += 1
            best = max(best, run)
        else:
            run = 0
    return best


def _letter_errors(doc: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Errors laid on each letter of ``text`` by its best alignment inside ``doc`` (free ends in ``doc``)."""
    n, m = len(doc), len(text)
    offset = np.arange(m + 1)
    d = np.zeros((n + 1, m + 1), np.int32)
    d[0] = offset
    for i in range(1, n + 1):
        row = np.minimum(d[i - 1] + 1, np.concatenate([[0], d[i - 1][:-1] + (text != doc[i - 1])]))
        row[0] = 0
        d[i] = np.minimum.accumulate(row - offset) + offset
    wrong = np.zeros(m, np.int32)
    # Item letters outside the document's cost one each, so the end with least errors may lie anywhere.
    i, j = int(d[:, m].argmin()), m
    while j > 0:
        here = d[i, j]
        if i > 0 and here == d[i - 1, j - 1] + (doc[i - 1] != text[j - 1]):
            wrong[j - 1] += doc[i - 1] != text[j - 1]
            i, j = i - 1, j - 1
        elif here == d[i, j - 1] + 1:
            wrong[j - 1] += 1
            j -= 1
        else:
            wrong[j - 1] += 1
            i -= 1
    return wrong


def _bridged(code, items: Items, p: dict, item: np.ndarray, x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each two lines x and y the first line between them that holds just the item's letters a..b, or -1."""
    out = np.full(len(x), -1, np.int64)
    want = b - a
    row, k = _expand(np.where(want > 0, np.maximum(0, y - x - 1), 0))
    z = x[row] + 1 + k
    near = np.abs(p["size"][z] - want[row]) <= np.maximum(2, want[row] // 6)
    row, z = row[near], z[near]
    # Letters that agree from the front, and from the back.
    keep = []
    for lo in range(0, len(row), BRIDGE_ROWS):
        r, line = row[lo : lo + BRIDGE_ROWS], z[lo : lo + BRIDGE_ROWS]
        size, n, text = p["size"][line][:, None], want[r][:, None], (items.start[item[r]] + a[r])[:, None]
        at = np.arange(int(n.max()))
        first, both = p["begin"][line][:, None], at < np.minimum(size, n)
        letter = lambda where: code[np.clip(where, 0, len(code) - 1)]
        wanted = lambda where: items.code[np.clip(where, 0, len(items.code) - 1)]
        ahead = (both & (letter(first + at) == wanted(text + at))).sum(axis=1)
        behind = (both & (letter(first + size - 1 - at) == wanted(text + n - 1 - at))).sum(axis=1)
        keep.append(np.maximum(ahead, behind) >= 0.25 * np.minimum(size, n)[:, 0])
    if keep:
        kept = np.concatenate(keep)
        row, z = row[kept], z[kept]
        most = np.maximum(2, (0.34 * want[row]).astype(np.int64))
        good = np.concatenate([_edits(code, p["begin"][z[c]], p["size"][z[c]], items.code, (items.start[item[row]] + a[row])[c], want[row[c]], most[c]) <= most[c] for c in (slice(i, i + BRIDGE_ROWS) for i in range(0, len(row), BRIDGE_ROWS))] or [np.zeros(0, bool)])
        row, z = row[good][::-1], z[good][::-1]
        out[row] = z  # the first of each, as it is written last
    return out


def _edits(one, begin, size, two, start, length, most) -> np.ndarray:
    """Edit distances of stretches of two letter streams, pair by pair; once one must exceed ``most``, any greater number."""
    n, width = len(begin), int(length.max())
    offset = np.arange(width + 1, dtype=np.int32)
    text = two[np.clip(start[:, None] + offset[None, :-1], 0, len(two) - 1)]
    row = np.repeat(offset[None], n, axis=0)
    out = np.where(size == 0, length, 1 << 30).astype(np.int32)
    live = np.arange(n)
    for i in range(int(size.max())):
        live = live[size[live] > i]
        if not len(live):
            break
        prev, letter = row[live], one[begin[live] + i]
        cur = np.empty_like(prev)
        cur[:, 0] = i + 1
        np.minimum(prev[:, 1:] + 1, prev[:, :-1] + (text[live] != letter[:, None]), out=cur[:, 1:])
        cur = np.minimum.accumulate(cur - offset, axis=1) + offset
        row[live] = cur
        ends = live[size[live] == i + 1]
        out[ends] = row[ends, length[ends]]
        # Beyond the text's end a row may still be low, so only its own places count.
        alive = np.where(offset[None] <= length[live, None], cur, 1 << 29).min(axis=1) <= most[live]
        live = live[alive]
    return out


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def leaked_items(documents: DataFrame, eval_items: DataFrame, rules: LeakRules = LeakRules(), block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, n_words) for every document that holds enough consecutive words of an item.

    The items are the query set: they are read in blocks of at most ``block_items``
    and about ``BLOCK_LETTERS`` letters, and each block goes over all documents
    twice, first to count how many documents have each n-gram (map-side, one row an
    n-gram of the items), then to join by the rare ones and align. Letters of all
    scripts count, see ``letters``; scripts without blanks have words by ``words_of``.
    Null texts and ids are left out, empty texts hold nothing, items shorter than the
    rule can not leak; repeated documents and items give their pairs once; texts of
    any length are read whole.
    """
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ids = eval_items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    total, size = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-total // block_items), -(-size // BLOCK_LETTERS))
    openings = _openings(ids, rules)
    out = None
    for k in range(blocks):
        rows = ids.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        for part in _runs(rows, block_items):
            found = _leaks_of_block(docs, Items([r[0] for r in part], [r[1] for r in part], rules, openings), rules)
            out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))


def _runs(rows: list, most: int) -> list[list]:
    """Items in runs of at most ``most`` and about ``BLOCK_LETTERS`` letters; one run if there are none."""
    out, letters_ = [[]], 0
    for r in rows:
        if out[-1] and (len(out[-1]) >= most or letters_ + len(r[1]) > BLOCK_LETTERS):
            out.append([])
            letters_ = 0
        out[-1].append(r)
        letters_ += len(r[1])
    return out


def _openings(ids: DataFrame, rules: LeakRules) -> set[str]:
    """Shared openings over all items: one aggregate a round, of which only shared ones return; rounds go on while there are any."""
    out: set[str] = set()
    first = r"(?s)^\s*(.*?(?:[.?!:](?=\s|$)|[。？！]))"
    rest = ids.select(F.trim("text").alias("t"))
    while True:
        opened = rest.select("t", F.regexp_extract("t", first, 1).alias("s")).where("s <> ''")
        shared = opened.groupBy("s").count().where(F.col("count") >= rules.shared_opening).select("s")
        new = [r[0] for r in shared.collect()]
        if not new:
            return out
        out |= set(new)
        rest = opened.join(shared, "s", "left_semi").select(F.trim(F.substr("t", F.length("s") + 1)).alias("t"))


def _leaks_of_block(docs: DataFrame, items: Items, rules: LeakRules) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    if not len(items.ids):
        return docs.select("doc_id", F.lit(0).cast("bigint").alias("item_id"), F.lit(0).cast("bigint").alias("n_words")).where("false")
    known = sc.broadcast(GramSet(items.seed))

    def count(batches):
        """Documents that have each n-gram, and under -1 all documents."""
        df, n = np.zeros(len(known.value.values), np.int64), 0
        for b in (x for whole in batches for x in slices(whole, 1)):
            n += b.num_rows
            code, owner, _ = letters(_texts(b.column(1)))
            at, j = known.value.hits(grams(code, owner, SEED))
            df += np.bincount(_distinct(owner[at].astype(np.int64) * len(df) + j) % len(df), minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], ["gram", "n"])

    totals = docs.mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    gram, n = totals["gram"].to_numpy(np.int64), totals["n"].to_numpy(np.int64)
    n_docs = int(n[gram < 0].sum())
    df = np.zeros(len(known.value.values), np.int64)
    df[gram[gram >= 0]] = n[gram >= 0]
    seeds = pick_seeds(items, known.value.values, df, n_docs, rules)
    shared = sc.broadcast((items, Places(items, known.value, seeds, rules)))

    def search(batches):
        its, places = shared.value
        for b in (x for whole in batches for x in slices(whole, 1)):
            found = find_leaks(b.column(0).to_numpy(), _texts(b.column(1)), its, known.value, places, rules)
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["doc_id", "item_id", "n_words"])

    return docs.mapInArrow(search, "doc_id bigint, item_id bigint, n_words bigint")


def leaks_of(spark, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
