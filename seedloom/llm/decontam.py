"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are sequences of word hashes. The CGK walk reads a sequence through random bits:
step j writes the current word and moves on if bit j of the word's hash is set, so two sequences
that differ by a few insertions, deletions or changes fall into step again and their walks agree
in most places: edit distance becomes Hamming distance. A walk starts at every word of every text and
at every word of every item. Each of several hashes samples places of the walk, one after the other, until
chance alone would hardly agree in them: the product of the corpus shares of the words read there
is ``CHANCE`` at most. A rare word is sampled once and found wherever it stands unedited; common words
need several places. So an item has as many short keys as its windows allow, and dense edits leave
some of them whole. A text follows only keys that begin like an item's. Where keys of two of an item's words
agree within an item-sized window, its surrounding is verified by exact edit distance.

Items are handed to the tasks in blocks of bounded size. An item that no key can tell apart is searched for by
its character trigrams.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.llm.common import Tokens, WordHashes, in_batches, slices_of, table, text_or_empty, word_of

# Share of an item's code points that may be edited in a passage that counts as the item.
MOST_EDITS = 0.2
# Probability that a key agrees with a place of a text by chance, and the number of places in the whole
# corpus that may always agree.
CHANCE, FEW_PLACES = 1e-5, 5
# Hashes, places of each at most, and steps from one place to the next at most (two steps read
# about one word).
HASHES, PLACES, GAP = 6, 12, 5
# An item with so many words that begin a key needs two of them in a window, one with fewer a single one.
SURE = 5
# Items with fewer words are searched for by trigrams.
FEW_WORDS = 8
# Items and words of a block.
ITEM_BLOCK, WORD_BLOCK = 20_000, 100_000
LANES = 1 << 15
# Windows verified together, code points of a piece of a window besides what an item spans, and 64-bit words
# of the longest item that is verified so.
TOGETHER, STRIDE, LONGEST = 1024, 256, 8
_ONE = np.uint64(1)


def hashes(count: int = HASHES, places: int = PLACES, gap: int = GAP, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each hash its sampled steps, the first of them 0, and an odd multiplier for each."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = []
    for _ in range(count):
        steps = np.r_[0, np.cumsum(rng.integers(1, gap + 1, places - 1))]
        out.append((steps, rng.integers(0, 2**63, places, dtype=np.uint64) * np.uint64(2) + _ONE))
    return out


def _mixed(words: np.ndarray) -> np.ndarray:
    return (words ^ (words >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def _advance(words, p, end, steps):
    """Walk on; bit j of a word is the j-th random function of the walk at that word."""
    for j in range(*steps):
        p += ((words[p] >> np.uint64(j % 62)) & _ONE).view(np.int64)
        np.minimum(p, end, out=p)


class Shares:
    """Share of the corpus that each word of the items has."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int):
        self.words, self.shares = words, (counts + 1.0) / (total + 1.0)
        self.chance = max(CHANCE, FEW_PLACES / (total + 1.0))

    def of(self, words: np.ndarray) -> np.ndarray:
        """The shares of words that are all known; 1 for the 0 after a last word."""
        if not len(self.words):
            return np.ones(len(words))
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.shares[at], 1.0)


class Index:
    """Keys of a block of items, for lookups from many walks."""

    def __init__(self, items: list[tuple[int, str]], shares: Shares, plan):
        words, chance = WordHashes(), shares.chance
        self.plan, self.items = plan, []
        self.short = []
        parts, owner, offset, ends, at = [], [], [], [], 0
        for item, text in items:
            h, _, _ = tokens(text, words)
            if len(h) < FEW_WORDS:
                if text.strip():
                    self.short.append((item, text))
                continue
            parts += [h, np.zeros(1, dtype=np.uint64)]
            owner.append(np.full(len(h) + 1, len(self.items)))
            offset.append(np.arange(len(h) + 1))
            ends.append(np.full(len(h) + 1, at + len(h)))
            at += len(h) + 1
            self.items.append((item, text, len(h)))
        empty = np.zeros(0, dtype=np.int64)
        self.keys, self.where, self.inner = np.zeros(0, dtype=np.uint64), np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.uint64)
        if parts:
            owner, offset, ends, all_words = map(np.concatenate, (owner, offset, ends, parts))
            leaves, inner, where = [], [], []
            start = np.flatnonzero(all_words)
            key, odds = _mixed(all_words[start]), shares.of(all_words)
            told = odds[start] <= chance
            leaves.append(key[told])
            where.append(start[told])
            inner.append(key[~told])
            for t, (steps, odd) in enumerate(plan):
                act, k = start[~told], key[~told] + np.uint64(t + 1)
                p, seen = act.copy(), odds[act]
                for m in range(1, len(steps)):
                    before = p.copy()
                    _advance(all_words, p, ends[act], (steps[m - 1], steps[m]))
                    # A word read again tells nothing new.
                    seen = seen * np.where(p != before, odds[p], 1.0)
                    k = k * odd[m] + _mixed(all_words[p])
                    on = p < ends[act]
                    leaf = on & ((seen <= chance) | (m + 1 == len(steps)))
                    leaves.append(k[leaf])
                    where.append(act[leaf])
                    on &= ~leaf
                    inner.append(k[on])
                    act, p, k, seen = act[on], p[on], k[on], seen[on]
            places = np.concatenate(where)
            keys = np.concatenate(leaves)
            order = np.argsort(keys, kind="stable")
            self.keys, self.inner = keys[order], np.concatenate(inner)
            self.where = np.stack([owner[places[order]], offset[places[order]]], axis=1)
            begins = np.bincount(owner[np.unique(places)], minlength=len(self.items))
            # Nothing tells such an item apart within its length.
            self.short += [self.items[i][:2] for i in np.flatnonzero(begins == 0)]
            self.need = np.where(begins >= SURE, 2, 1)
        bits = int(np.clip(np.ceil(np.log2(8 * (len(self.keys) + len(self.inner)) + 1)), 12, 24))
        self.shift = np.uint64(64 - bits)
        self.leaf_flags, self.inner_flags = np.zeros(1 << bits, dtype=bool), np.zeros(1 << bits, dtype=bool)
        self.leaf_flags[self.keys >> self.shift] = True
        self.inner_flags[self.inner >> self.shift] = True
        self.none = empty

    def _agreeing(self, at: np.ndarray, key: np.ndarray):
        maybe = self.leaf_flags[key >> self.shift]
        at, key = at[maybe], key[maybe]
        lo = np.searchsorted(self.keys, key, "left")
        same = self.keys[np.minimum(lo, len(self.keys) - 1)] == key
        at, key, lo = at[same], key[same], lo[same]
        n = np.searchsorted(self.keys, key, "right") - lo
        rows = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(at, n), self.where[rows, 0], self.where[rows, 1]

    def candidates(self, words: np.ndarray, ends: np.ndarray):
        """Arrays (position, item number, offset in the item) of places where a whole key agrees.

        ``words`` has a 0 after each text, and ``ends[i]`` is the index of the 0 after position i.
        """
        if not len(self.keys):
            return self.none, self.none, self.none
        start = np.flatnonzero(words)
        key = _mixed(words[start])
        found = [self._agreeing(start, key)]
        on = self.inner_flags[key >> self.shift]
        first, first_key = start[on], key[on]
        for t, (steps, odd) in enumerate(self.plan):
            act, k = first, first_key + np.uint64(t + 1)
            p, end = act.copy(), ends[act]
            for m in range(1, len(steps)):
                if not len(act):
                    break
                _advance(words, p, end, (steps[m - 1], steps[m]))
                k = k * odd[m] + _mixed(words[p])
                on = p < end
                found.append(self._agreeing(act[on], k[on]))
                on &= self.inner_flags[k >> self.shift]
                act, p, end, k = act[on], p[on], end[on], k[on]
        return tuple(np.concatenate(part) for part in zip(*found))


def tokens(text: str, words: WordHashes) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Hashes of the words of a text, all its tokens, and the places of the words among the tokens."""
    got = text.split()
    h = np.fromiter(map(words.__getitem__, got), dtype=np.uint64, count=len(got))
    at = np.flatnonzero(h)
    return h[at], got, at


class Short:
    """Search for items by their character trigrams, all items in one pass over a text.

    An edit takes at most three trigrams away, and the others stand in the text within the item's length and
    the edits. Only such places are verified. Without room for an edit, the item stands between
    characters that are no letters or digits; in scripts without case, anywhere.
    """

    def __init__(self, items: list[tuple[int, str]], most: float):
        self.most = most
        self.items = [(item, _plain(text)) for item, text in items]
        grams = [np.sort(_trigrams(text)) for _, text in self.items]
        self.grams = np.unique(np.concatenate([*grams, np.zeros(0, dtype=np.int64)]))
        self.of_item = [np.searchsorted(self.grams, g) for g in grams]
        self.need = np.array([len(g) - int(3 * most * len(text)) for g, (_, text) in zip(grams, self.items)])
        self.starts = np.cumsum([0, *map(len, grams)])

    def find(self, text: str):
        """(item, distance, start of the passage) of the items that a plain text holds."""
        held = _trigrams(text)
        at = np.searchsorted(self.grams, held)
        at[at == len(self.grams)] = 0
        known = np.flatnonzero(self.grams[at] == held) if len(self.grams) else np.zeros(0, dtype=np.int64)
        gram = at[known]
        order = np.argsort(gram, kind="stable")
        gram, place = gram[order], known[order]
        present = np.zeros(len(self.grams) + 1, dtype=np.int64)
        present[gram] = 1
        together = np.r_[0, np.cumsum(present[np.concatenate([*self.of_item, np.zeros(0, dtype=np.int64)]).astype(np.int64)])]
        counts = together[self.starts[1:]] - together[self.starts[:-1]]
        for no in np.flatnonzero(counts >= self.need):
            item, plain = self.items[no]
            if not int(len(plain) * self.most):
                hit = _exact(plain).search(text)
                if hit:
                    yield item, 0, hit.start()
                continue
            best = None
            for lo, hi in self._places(no, gram, place, len(text)):
                d, end = infix_distance(plain, text[lo:hi])
                if d <= self.most * len(plain) and (best is None or d < best[0]):
                    best = d, max(0, lo + end - len(plain))
            if best:
                yield item, *best

    def _places(self, no: int, gram, place, size: int):
        """Stretches of the text with as many trigrams of the item as a passage of it must have."""
        plain, need = self.items[no][1], int(self.need[no])
        reach = len(plain) + int(len(plain) * self.most)
        if need <= 0:
            return [(0, size)]
        mine = np.unique(self.of_item[no])
        lo, hi = np.searchsorted(gram, mine, "left"), np.searchsorted(gram, mine, "right")
        at = np.sort(np.concatenate([place[x:y] for x, y in zip(lo, hi)]))
        first = at[np.searchsorted(at, at + reach, "left") - np.arange(len(at)) >= need]
        out: list[list[int]] = []
        for x in first.tolist():
            a, b = max(0, x - reach), min(size, x + 2 * reach)
            if out and a <= out[-1][1]:
                out[-1][1] = b
            else:
                out.append([a, b])
        return out


def _trigrams(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:] if len(c) > 2 else np.zeros(0, dtype=np.int64)


def _exact(item: str) -> re.Pattern:
    edge = lambda c: c.isdigit() or c.lower() != c.upper()
    return re.compile((r"(?<![^\W_])" if edge(item[0]) else "") + re.escape(item) + (r"(?![^\W_])" if edge(item[-1]) else ""))


def infix_distance(item: str, window: str) -> tuple[int, int]:
    """Least edit distance of ``item`` to any part of ``window``, and where that part ends.

    Bit-parallel: one step for each character of the window, a bit for each of the item.
    """
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(window):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, at + 1
    return best, end


def infix_distances(items: list[str], windows: list[str], most: float) -> np.ndarray:
    """:func:`infix_distance` of each item and its window, as far as it is ``most`` of the item's code points or less;
    else any number above that.

    A passage within that distance is no longer than the item and its edits, so windows are cut into pieces
    that overlap by as much. Pieces walk side by side, a column of 64-bit words each.
    """
    out = np.array([len(item) for item in items], dtype=np.int64)
    lanes = []
    for i, (item, window) in enumerate(zip(items, windows)):
        reach = len(item) + int(len(item) * most)
        lanes += [(-(-len(item) // 64), i, window[at : at + STRIDE + reach]) for at in range(0, max(1, len(window) - reach), STRIDE)]
    lanes.sort(key=lambda lane: (lane[0], len(lane[2])))
    long = sum(lane[0] <= LONGEST for lane in lanes)
    for at in [*range(0, long, TOGETHER), *range(long, len(lanes), TOGETHER)]:
        some = lanes[at : min(at + TOGETHER, long if at < long else len(lanes))]
        n = some[-1][0]
        # A step of all lanes takes about as long as one of sixteen strings for each word.
        if n > LONGEST or len(some) < 16 * n:
            found = [infix_distance(items[i], part)[0] for _, i, part in some]
        else:
            found = _side_by_side([items[i] for _, i, _ in some], [part for _, _, part in some], n)
        np.minimum.at(out, [i for _, i, _ in some], found)
    return out


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _side_by_side(items: list[str], windows: list[str], n: int) -> np.ndarray:
    """Infix distances of items of at most ``n`` 64-bit words, one lane for each.

    An item ends at the highest bit; the bits before it agree with every letter, so they stay at distance 0. Windows
    are filled up with a code that no item has, which brings no item closer.
    """
    known: dict[str, tuple[int, np.ndarray]] = {}
    masks: list[int] = []
    codes = np.empty((max(map(len, windows)), len(items)), dtype=np.int64)
    plus = np.zeros((n, len(items)), dtype=np.uint64)
    parts = lambda mask: [mask >> 64 * w & (1 << 64) - 1 for w in range(n)]
    for lane, (item, window) in enumerate(zip(items, windows)):
        free = 64 * n - len(item)
        if item not in known:
            held: dict[str, int] = {}
            for i, c in enumerate(item, free):
                held[c] = held.get(c, (1 << free) - 1) | 1 << i
            letters = sorted(held)
            known[item] = len(masks), np.array([*map(ord, letters)], dtype=np.uint32)
            masks += [(1 << free) - 1, *map(held.get, letters)]
        none, letters = known[item]
        read = _code_points(window)
        at = np.minimum(np.searchsorted(letters, read), len(letters) - 1)
        codes[: len(read), lane] = np.where(letters[at] == read, none + 1 + at, none)
        codes[len(read) :, lane] = none
        plus[:, lane] = parts((1 << 64 * n) - (1 << free))
    of_code = np.array([*map(parts, masks)], dtype=np.uint64).T.copy()
    last = np.uint64(63)
    minus = np.zeros_like(plus)
    score = np.array([*map(len, items)], dtype=np.int64)
    best = score.copy()
    for code in codes:
        eq = of_code.take(code, axis=1)
        xv = eq | minus
        both = eq & plus
        total = both + plus
        over = total[0] < plus[0]
        for w in range(1, n):
            total[w] += over
            over = (total[w] < plus[w]) | (over & (total[w] == plus[w]))
        xh = (total ^ plus) | eq
        ph, mh = minus | ~(xh | plus), plus & xh
        score += (ph[-1] >> last).view(np.int64)
        score -= (mh[-1] >> last).view(np.int64)
        np.minimum(best, score, out=best)
        for h in (ph, mh):
            carried = h[:-1] >> last
            h <<= _ONE
            h[1:] |= carried
        plus, minus = mh | ~(xv | ph), ph & xv
    return best


def _plain(text: str) -> str:
    return " ".join(text.lower().split())


_FOUND = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("distance", pa.int64()), ("first_word", pa.int64()), ("n_windows", pa.int64())])


def _scan(items: list[tuple[int, str]], shares: Shares, most: float, plan=None):
    plan = plan or hashes()

    def run(batches):
        index = Index(items, shares, plan)
        plain = [_plain(text) for _, text, _ in index.items]
        size = np.array([n for _, _, n in index.items], dtype=np.int64)
        shorts = Short(index.short, most) if index.short else None

        def rows():
            for batch in slices_of(batches, 1):
                docs, texts = batch.columns
                if shorts:
                    for i in range(batch.num_rows):
                        low = _plain(texts[i].as_py())
                        for item, d, start in shorts.find(low):
                            yield docs[i].as_py(), item, d, low.count(" ", 0, start), 1
                if len(index.items):
                    for i, *found in scanned(Tokens(texts)):
                        yield docs[i].as_py(), *found

        def supported(hits):
            """Hits of items that one is enough for, and those with another word's hit in the window."""
            if not len(hits):
                return np.zeros(0, dtype=bool)
            g, no, start, offset = hits.T
            slack = (size[no] * most).astype(np.int64) + 2
            keep = index.need[no] == 1
            # Hits stand by text, item and start: another word's hit is a neighbour, or behind
            # neighbours of the same word.
            word = offset.copy()
            for step in range(1, len(hits)):
                pair = (g[step:] == g[:-step]) & (no[step:] == no[:-step]) & (start[step:] - start[:-step] <= slack[step:])
                if not pair.any():
                    break
                pair &= word[step:] != word[:-step]
                keep[step:] |= pair
                keep[:-step] |= pair
            return keep

        def scanned(all_tokens):
            """Verified items of several texts: number of the text, item, distance, first word, windows."""
            h = all_tokens.hashes()
            at = np.flatnonzero(h)
            # Words of text g are at[first[g]] to at[first[g + 1]].
            first = np.searchsorted(at, all_tokens.ends)
            spans: list[tuple[int, int, int, int]] = []
            g = 0
            while g < len(first) - 1:
                # Walks of several texts at once, each ended by a 0.
                to = max(g + 1, int(np.searchsorted(first, first[g] + LANES, "right")) - 1)
                starts = first[g : to + 1] - first[g] + np.arange(to - g + 1)
                lengths = np.diff(starts)
                all_words = np.zeros(starts[-1], dtype=np.uint64)
                all_words[np.arange(first[to] - first[g]) + np.repeat(np.arange(to - g), lengths - 1)] = h[at[first[g] : first[to]]]
                place, no, offset = index.candidates(all_words, np.repeat(starts[1:] - 1, lengths))
                k = np.searchsorted(starts, place, "right") - 1
                hits = np.unique(np.stack([k, no, place - starts[k] - offset, offset], axis=1), axis=0)
                spans += windows(hits[supported(hits)][:, :3], lengths - 1, g)
                g = to
            # Tokens without a word belong to the window, those next to its ends as well.
            texts = []
            for g, _, lo, hi in spans:
                x = at[first[g] + lo - 1] + 1 if lo else all_tokens.ends[g]
                y = at[first[g] + hi] if first[g] + hi < first[g + 1] else all_tokens.ends[g + 1]
                texts.append(" ".join(all_tokens.flat.slice(x, y - x).to_numpy(zero_copy_only=False)).strip(" ").lower())
            distances = infix_distances([plain[no] for _, no, _, _ in spans], texts, most).tolist()
            near: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for (g, no, lo, _), d in zip(spans, distances):
                near.setdefault((g, no), []).append((d, lo))
            for (g, no), found in near.items():
                d, lo = min(found)
                if d <= most * len(plain[no]):
                    yield g, index.items[no][0], d, lo, len(found)

        def windows(hits, lengths, g):
            """(text, item number, first word, word after the last) around the hits, those of one place joined."""
            out: list[list[int]] = []
            for k, no, start in hits.tolist():
                n = int(size[no])
                slack = int(n * most) + 2
                lo, hi = max(0, start - slack), min(int(lengths[k]), start + n + slack)
                if out and out[-1][:2] == [g + k, no] and lo <= out[-1][3]:
                    out[-1][3] = hi
                else:
                    out.append([g + k, no, lo, hi])
            return out

        return in_batches(rows(), _FOUND)

    return run


def word_shares(texts: DataFrame, items: list[tuple[int, str]]) -> Shares:
    """(text) -> shares that the words of ``items`` have among all words of the texts."""
    words = WordHashes()
    known = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *[words.of(text) for _, text in items]]))

    of_word = {word_of(token): 0 for _, text in items for token in text.split()}
    of_word = {word: int(np.searchsorted(known, words[word])) for word in of_word if word}

    def run(batches):
        held, total = np.zeros(len(known) + 1, dtype=np.int64), 0
        for batch in slices_of(batches, 0):
            read = Tokens(batch.column(0))
            n = np.bincount(read.places, minlength=len(read.distinct))
            found = [of_word.get(word, -1) if word else -2 for word in read.words()]
            at = np.array(found, dtype=np.int64)
            total += int(n[at > -2].sum())
            np.add.at(held, at[at >= 0], n[at >= 0])
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1], pa.int64()), pa.array(np.r_[held[some], total], pa.int64())], names=["word", "n"])

    got = texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    counts, word = np.zeros(len(known), dtype=np.int64), got["word"].to_numpy(dtype=np.int64)
    n = got["n"].to_numpy(dtype=np.int64)
    counts[word[word >= 0]] = n[word >= 0]
    return Shares(known, counts, int(n[word < 0].sum()))


def _blocks(items):
    """Items in blocks of at most ITEM_BLOCK, cut where their words reach WORD_BLOCK."""
    held, size = [], 0
    for row in items:
        held.append((row["item"], row["text"]))
        size += len(row["text"].split()) + 1
        if len(held) >= ITEM_BLOCK or size >= WORD_BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaked_items(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    most: float = MOST_EDITS,
) -> DataFrame:
    """One row per document and benchmark item whose text it holds: doc_id, item_id, distance
    (edits of the nearest passage, in code points of lower-case text with single spaces),
    first_word (start of the passage's surroundings), n_windows.

    A passage counts if at most ``most`` of the item's code points are edited. Null and empty texts
    and items hold nothing; items of fewer than ``FEW_WORDS`` words, or of words too common to tell
    them apart, are searched for by trigrams, those without room for an edit as whole words.
    Repeated rows of a document each count; their findings are given once. Null ids stay null.
    Other columns are ignored. An empty table gives no rows.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc"), text_or_empty(text).alias("text"))
    b = benchmark.select(F.col(item_id).cast("long").alias("item"), text_or_empty(item_text).alias("text")).distinct()
    kinds = "doc long, item long, distance long, first_word long, n_windows long"
    parts = [d.mapInArrow(_scan(held, word_shares(d.select("text"), held), most), kinds) for held in _blocks(b.toLocalIterator())]
    out = parts[0] if parts else d.limit(0).selectExpr("doc", "doc as item", "doc as distance", "doc as first_word", "doc as n_windows")
    for part in parts[1:]:
        out = out.unionAll(part)
    return out.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(
        F.min("distance").alias("distance"), F.min_by("first_word", "distance").alias("first_word"), F.sum("n_windows").alias("n_windows")
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
