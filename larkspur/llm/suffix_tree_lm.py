"""Language-model scoring with a probabilistic suffix tree over words.

The root is the smoothed word distribution. A context of up to `depth` words is a candidate if it occurs at least `least`
times in the training text, a fixed count, so the tree grows with the corpus (where so few can't pass the test below, one more); likewise a context's own distribution names
the symbols that follow it at least that often and leaves the rest of its mass to its suffix. A candidate becomes a state
if its distribution diverges from its suffix's: its count times the divergence must pass a
multiple of the logarithm of the corpus size. A token is scored in the state of the longest suffix of its past that is one.

All counts are taken over all training documents, and no task holds the tree. Depth by depth each block sends its distinct
contexts with their followers to the parts that contexts are dealt to by hash; a part sees all of a context, decides
whether it is a state, and answers every block with what concerns its own entries. So a block holds the tree restricted to
its text. The number of parts grows with that of the blocks. The followers of a context that occurs more than `split` times are dealt to
several parts, each of which answers with its share of the sums that decide; the block adds them up. Contexts are known by
64-bit hashes there, whose equality stands for that of the words. Those of few words travel as rising word numbers, which take
less room than hashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.blocks import Numbers, by_document, dealt, opened, packed, to_blocks, unpacked
from larkspur.llm.common import freed, trimmed, written_by
from larkspur.storage import remove, table_path

#: Separates nothing and is no word: the token that ends every text, and the past of its first word.
END = b""


#: Text in a block: larger ones hold fewer (context, word) pairs in all, but a worker holds a block's tokens several times.
BLOCK = 8 << 20

#: Contexts of up to so many words travel as words, which take less room than a hash.
SPELLED = 2


@dataclass(frozen=True)
class Rule:
    """What makes an entry and a state."""

    least: int
    discount: float
    strictness: float
    tokens: int

    @property
    def fewest(self) -> int:
        """Occurrences from which on a context may be a state.

        One that occurs `least` times has at most one entry, with all of them. The entry is one of the suffix's too, so it
        has a probability of (least - discount) / tokens there or more, which bounds the divergence. Whatever begins with
        such a context occurs no more often, so nothing is lost by leaving both out.
        """
        tokens = max(self.tokens, 2)
        never = self.least * np.log(1.04 * tokens / max(self.least - self.discount, 1e-9)) <= self.strictness * np.log(tokens)
        return self.least + 1 if never else self.least

    def states(self, gain: np.ndarray, covered: np.ndarray, likely: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Which contexts are states, from sums over their entries: see shares(). Contexts without entries are none."""
        rest = total - covered
        gain = gain - covered * np.log(np.maximum(total, 1))
        gain += np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / (np.maximum(total, 1) * np.maximum(1 - likely, 1e-12))), 0.0)
        return (gain > self.strictness * np.log(max(self.tokens, 2))) & (covered > 0)

    def shares(self, owner: np.ndarray, counts: np.ndarray, shorter: np.ndarray, contexts: int) -> tuple[np.ndarray, ...]:
        """Sums over entries by context: count * log(count / shorter), counts, probabilities in the suffix, discounted counts."""
        columns = (counts * np.log(counts / shorter), counts, shorter, counts - self.discount)
        return tuple(np.bincount(owner, c, contexts).astype(float) for c in columns)


def splitter():
    def number(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """See blocks.numbered(). Lower case and blanks are ASCII's only: A-Z, and blank with the controls 9 to 13."""
        words = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
        text, flat = pc.list_parent_indices(words), words.flatten()
        some = pc.not_equal(flat, "")  # blanks at either end leave empty words
        sizes = np.bincount(text.filter(some).to_numpy(), minlength=len(texts))
        coded = flat.filter(some).dictionary_encode()
        numbers, end = coded.indices.to_numpy().astype(np.uint32), len(coded.dictionary)
        ends = np.cumsum(sizes)
        return pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([END])]), np.insert(numbers, ends, np.uint32(end)), sizes + 1

    return number


def mixed(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hash of a context's hash and the word that follows it (both uint64)."""
    x = key * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pressed(values: np.ndarray) -> bytes:
    """Numbers as bytes, plane by plane, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def loose(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def together(columns: list[np.ndarray]) -> bytes:
    """Several columns pressed() into one value: how many, their lengths, and they."""
    found = list(map(pressed, columns))
    return np.array([len(found), *map(len, found)], "<u4").tobytes() + b"".join(found)


def apart(data: bytes, kind) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = 4 + 4 * n + np.cumsum([0, *np.frombuffer(data, "<u4", n, 4)])
    return [loose(data[a:b], kind) for a, b in zip(ends[:-1], ends[1:])]


def steps(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Differences of numbers that rise within runs; the first of each run, where new is true, stays whole."""
    return np.where(new, values, np.diff(values, prepend=values[:1]))


def climbed(found: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The numbers whose steps() were found."""
    sums, begin = np.cumsum(found, dtype=found.dtype), np.flatnonzero(new)
    return sums - np.repeat((sums - found)[begin], np.diff(begin, append=len(found)))


def begins(runs: np.ndarray) -> np.ndarray:
    """Marks the first element of each run of so many; empty runs have none."""
    new = np.zeros(int(runs.sum()), bool)
    new[(np.cumsum(runs) - runs)[runs > 0]] = True
    return new


def changes(values: np.ndarray) -> np.ndarray:
    """Marks what differs from its predecessor, and the first."""
    return np.diff(values, prepend=~values[:1]) != 0


def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of numbers from 0, and the numbers in it. Sorting them with their places in the low bits is faster than argsort()."""
    low = max(len(keys), 1).bit_length()
    if int(keys.max(initial=0)).bit_length() + low > 62:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    both = keys << low
    both |= np.arange(len(keys))
    both.sort()
    order = both & ((1 << low) - 1)
    both >>= low
    return order, both


def hash_order(hashes: np.ndarray) -> np.ndarray:
    """Order of 64-bit hashes, sorted as ordered() does by their leading bits; should these not decide, by all."""
    low = np.uint64(max(len(hashes), 1).bit_length())
    both = np.sort(((hashes >> low) << low) | np.arange(len(hashes), dtype=np.uint64))
    order = (both & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    found = hashes[order]
    return np.argsort(hashes, kind="stable") if (found[1:] < found[:-1]).any() else order


def coarse(p: np.ndarray) -> np.ndarray:
    """Probabilities as floats of 5 bits, 3 % off at most, enough to tell how far distributions diverge."""
    return ((p.astype("<f4").view("<u4") + np.uint32(0x40000)) & np.uint32(0xFFF80000)).view("<f4")


@dataclass
class Block:
    """A block's tokens under its own word numbers, and the tree restricted to them as deep as it has grown.

    symbol is -1 for rare words; word has each number's one in the corpus, both rise together. path has the words of each context, a column
    for each; contexts are numbered in the order of their words. context is the number of each token's past of
    the depth that comes next, -1 if it is no candidate; key and total are those contexts' hashes and training counts,
    lone says which ones no other block has, in training or in held-out text. p is each token's probability in the longest
    state so far; seen says which tokens are entries of the suffix of their context, since others can't be of the context.
    """

    symbol: np.ndarray
    first: np.ndarray
    train: np.ndarray
    word: np.ndarray
    p: np.ndarray
    context: np.ndarray
    key: np.ndarray
    total: np.ndarray
    lone: np.ndarray
    seen: np.ndarray
    path: list[np.ndarray]

    @property
    def spelled(self) -> bool:
        return len(self.path) <= SPELLED


def planted(symbol: np.ndarray, first: np.ndarray, train: np.ndarray, word: np.ndarray, total: np.ndarray, lone: np.ndarray, end: int, p: np.ndarray, fewest: int) -> Block:
    """A block with the root alone: the past of a text's first token is the end token, contexts don't cross texts."""
    context = np.where(first, end, np.concatenate([[end], symbol[:-1]])) if len(symbol) else symbol
    context = np.where((context >= 0) & (total[context] >= fewest), context, -1)
    return Block(symbol, first, train, word, p, context, mixed(word, np.zeros(len(word), np.uint64)), total, lone, symbol >= 0, [word])


@dataclass
class Question:
    """A block's distinct (context, symbol) of one depth, and what goes to which part.

    on: tokens with a context; code: the number of each one's pair; context, symbol (-1 for rare), n and token by pair.
    rest: training occurrences of each row's context in the block without those of its pairs, 0 but in the first split.
    A context that no other block has needs no question: own marks its pairs. part, asked, key:
    the other contexts and their hashes by part, one row for each split of a context, whose number and how many there are
    number and split have; row: the row of each pair, -1 for
    what can't be an entry and pairs of own contexts.
    """

    on: np.ndarray
    code: np.ndarray
    context: np.ndarray
    symbol: np.ndarray
    n: np.ndarray
    token: np.ndarray
    own: np.ndarray
    part: np.ndarray
    asked: np.ndarray
    key: np.ndarray
    number: np.ndarray
    split: np.ndarray
    rest: np.ndarray
    row: np.ndarray

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that are sent, by row, and how many each row has."""
        some = np.flatnonzero(self.row >= 0)
        order, row = ordered(self.row[some])
        return some[order], np.bincount(row, minlength=len(self.asked))


def question(block: Block, parts: int, split: int) -> Question:
    on = np.flatnonzero(block.context >= 0)
    wide = len(block.word) + 1
    codes = block.context[on]
    codes *= wide
    codes += block.symbol[on]
    codes += 1
    order, codes = ordered(codes)
    new = np.diff(codes, prepend=-1) != 0
    code = np.empty(len(on), np.int32)
    code[order] = np.cumsum(new, dtype=np.int32) - 1
    starts = np.flatnonzero(new)
    n = np.add.reduceat(block.train[on][order], starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    context, symbol, token = codes[starts] // wide, codes[starts] % wide - 1, on[order[starts]]
    # a context's pairs are neighbours; it asks each of its splits, most contexts have one
    mine = np.flatnonzero(np.diff(context, prepend=-1))
    of = np.cumsum(np.diff(context, prepend=-1) != 0) - 1
    whole = block.lone[context[mine]]
    splits = np.where(whole, 0, 1 + block.total[context[mine]] // split)
    asked = np.repeat(context[mine], splits)
    begin = np.cumsum(splits) - splits
    number = np.arange(len(asked)) - np.repeat(begin, splits)
    key = mixed(block.key[asked], number.astype(np.uint64))
    part = (key % np.uint64(parts)).astype(np.int64)
    by_part = np.arange(len(key)) if block.spelled else hash_order(key)  # rising words or keys in each part
    by_part = by_part[np.argsort(part[by_part].astype(np.uint16) if parts < 1 << 16 else part[by_part], kind="stable")]
    place = np.empty(len(asked), np.int64)
    place[by_part] = np.arange(len(asked))
    own, row = whole[of], np.full(len(symbol), -1, np.int64)
    go = np.flatnonzero(block.seen[token] & ~own)
    left = np.bincount(of, n, len(mine)) - np.bincount(of[go], n[go], len(mine))
    rest = np.zeros(len(asked), np.int64)
    some = splits > 0
    rest[begin[some]] = left[some]
    chosen = mixed(block.word[symbol[go]], np.full(1, 7, np.uint64)) % splits[of[go]].astype(np.uint64)
    row[go] = place[begin[of[go]] + chosen.astype(np.int64)]
    return Question(on, code, context, symbol, n, token, own, part[by_part], asked[by_part], key[by_part], number[by_part], np.repeat(splits, splits)[by_part], rest[by_part], row)


def sent(block: Block, q: Question) -> Iterator[tuple]:
    """For each part: the rows' contexts, a column for each word or one of keys (48 bits), as differences; rests, numbers and splits of the rows, how
    many pairs each has; word, as differences within a row, and n of the pairs; shorter as shortened() has it.
    """
    pairs, runs = q.pairs()
    ends = np.concatenate([[0], np.cumsum(runs)])
    for k in np.unique(q.part).tolist():
        a, b = np.searchsorted(q.part, k), np.searchsorted(q.part, k, "right")
        some = pairs[ends[a] : ends[b]]
        names, new = [], np.arange(b - a) == 0
        for x in [w[q.asked[a:b]] for w in block.path] if block.spelled else [q.key[a:b] >> np.uint64(16)]:
            names.append(steps(x, new).astype("<u8"))
            new = new | changes(x)
        word, n = block.word[q.symbol[some]], q.n[some]
        yield k, names, q.rest[a:b].astype("<i4"), q.number[a:b].astype("<i4"), q.split[a:b].astype("<i4"), runs[a:b].astype("<i4"), steps(word, begins(runs[a:b])).astype("<u8"), n.astype("<i4"), shortened(block.p[q.token[some]], word, n, len(block.path))


def shortened(p: np.ndarray, word: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """coarse() probabilities of pairs in the suffix of their context, what can differ of their bits.

    In the root they are the words' own, so each word has one, as a difference. Deeper a block without training
    occurrences of a pair leaves the probability to those that have some.
    """
    found = np.unique(word, return_index=True)[1] if depth == 1 else np.flatnonzero(n > 0)
    bits = (coarse(p[found]).view("<u4") >> np.uint32(19)).astype("<u2")
    return np.diff(bits, prepend=np.uint16(0)) if depth == 1 else bits


def lengthened(bits: np.ndarray, word: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """The probabilities of pairs that were shortened(), 0 where they were left out."""
    out = np.zeros(len(word), "<u4")
    if depth == 1:
        out[:] = np.cumsum(bits, dtype="<u2")[np.unique(word, return_inverse=True)[1]]
    else:
        out[n > 0] = bits
    return (out << np.uint32(19)).view("<f4")


def named(names: list[np.ndarray], number: np.ndarray, spelled: bool) -> np.ndarray:
    """The keys of rows that were sent()."""
    new = np.arange(len(number)) == 0
    key = x = climbed(names[0], new)
    if not spelled:
        return key
    key = mixed(key, np.zeros(len(key), np.uint64))
    for y in names[1:]:
        new = new | changes(x)
        x = climbed(y, new)
        key = mixed(key, x)
    return mixed(key, number.astype(np.uint64))


def judged(key: np.ndarray, rest: np.ndarray, splits: np.ndarray, runs: np.ndarray, word: np.ndarray, n: np.ndarray, shorter: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The answers to all rows and pairs of a part, from any number of blocks, in their order.

    Twice each pair's count in the corpus, 0 if it is no entry, and 1 more if it is in one block only; each row's verdict: 0 for no state, 1 for a state, 2 for a split
    context, whose sums have to be added up; four sums for each row, zeros but for splits and the last one of states.
    """
    names, at = np.unique(key, return_inverse=True)
    pair = mixed(np.repeat(key, runs), word)
    order = hash_order(pair)
    new = np.diff(pair[order], prepend=~pair[order[:1]]) != 0
    starts = np.flatnonzero(new)
    counts = np.add.reduceat(n[order].astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    entry = counts >= rule.least
    one = order[starts][entry]
    likely = np.maximum.reduceat(shorter[order], starts)[entry] if len(starts) else shorter
    sums = np.stack(rule.shares(np.repeat(at, runs)[one], counts[entry].astype(float), likely.astype(float), len(names)), axis=1)
    totals = np.bincount(at, rest, len(names)) + np.bincount(np.repeat(at, runs), n, len(names))  # every block that has a context asks
    several = np.zeros(len(names), bool)
    several[at] = splits > 1
    state = rule.states(*sums[:, :3].T, totals)
    verdict = np.where(several, 2, state).astype(np.uint8)
    sums[verdict == 0] = 0
    sums[verdict == 1, :3] = 0
    own = np.empty(len(order), np.int64)
    alone = np.diff(starts, append=len(order)) == 1  # a block has a pair once
    own[order] = np.where(entry, 2 * counts + alone, 0)[np.cumsum(new) - 1]
    return own, verdict[at], sums[at]


def told(verdict: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """What judged() has in sums: one of each state, all four of splits."""
    return np.concatenate([sums[verdict == 1, 3], sums[verdict == 2].ravel()])


def heard(verdict: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The sums that were told()."""
    out, one = np.zeros((len(verdict), 4)), verdict == 1
    out[one, 3], out[verdict == 2] = found[: one.sum()], found[one.sum() :].reshape(-1, 4)
    return out


def deepened(block: Block, q: Question, replies: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], rule: Rule) -> None:
    """Scores a block's tokens one depth deeper, and gives it the contexts of the next one."""
    counts = np.zeros(len(q.row), np.int64)
    own, verdict, sums = (np.concatenate([np.zeros((0, *shape)), *(replies[k][i] for k in sorted(replies))]) for i, shape in enumerate(((), (), (4,))))
    own = own.astype(np.int64)  # without replies it has no kind
    counts[q.pairs()[0]] = own >> 1
    lone = q.own.copy()
    lone[q.pairs()[0]] = own & 1
    here = np.flatnonzero(q.own & (q.symbol >= 0) & (q.n >= rule.least))
    counts[here] = q.n[here]
    added = np.stack(rule.shares(q.context[here], q.n[here].astype(float), coarse(block.p[q.token[here]]).astype(float), len(block.key)), axis=1)
    state, kept = rule.states(*added[:, :3].T, block.total.astype(float)), added[:, 3]
    whole = verdict == 1
    state[q.asked[whole]], kept[q.asked[whole]] = True, sums[whole, 3]
    parted = verdict == 2
    if parted.any():
        added = np.zeros((len(block.key), 4))
        np.add.at(added, q.asked[parted], sums[parted])
        some = np.unique(q.asked[parted])
        state[some] = rule.states(*added[some, :3].T, block.total[some].astype(float))
        kept[some] = added[some, 3]
    for a in range(0, len(q.on), 1 << 18):  # pieces take less memory
        t, n = q.on[a : a + (1 << 18)], counts[q.code[a : a + (1 << 18)]]
        c = block.context[t]
        inside = state[c]
        t, c, n = t[inside], c[inside], n[inside]
        block.p[t] = (np.where(n > 0, n - rule.discount, 0.0) + (block.total[c] - kept[c]) * block.p[t]) / block.total[c]
    block.seen = np.zeros(len(block.symbol), bool)
    block.seen[q.on] = (counts >= rule.least)[q.code]
    entry = counts >= rule.fewest
    number = np.where(entry, np.cumsum(entry) - 1, -1)
    after = np.full(len(block.symbol), -1, np.int64)
    after[q.on] = number[q.code]
    block.context = np.roll(after, 1)
    block.context[block.first] = -1
    block.path = [*(x[q.context[entry]] for x in block.path), block.word[q.symbol[entry]]]
    block.key, block.total, block.lone = mixed(block.key[q.context[entry]], block.word[q.symbol[entry]]), counts[entry], lone[entry]


def _batch(values: tuple, schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], types[t]) for v, (_, t) in zip(values, fields)], names=[name for name, _ in fields])


#: Rows of negative blocks hold what a part says of itself.
TOTALS = "part int, block long, nos binary, c binary, symbol binary, end_at long, known long"
QUESTIONS = "part int, block long, names binary, rests binary, numbers binary, splits binary, runs binary, words binary, n binary, shorter binary"
REPLIES = "part int, block long, counts binary, verdicts binary, sums binary"


def lm_score(docs: DataFrame, train, depth: int = 3, least: int = 2, discount: float = 0.75, strictness: float = 2.0, split: int = 1 << 23) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10, of the whole text).

    train: a boolean column over docs that marks the training documents; null counts as false. Tokens are the words of
    the text after lower-casing A-Z and one end token; a null or empty text is one end token, a text of any length is one
    sequence. Without training documents every token has the root probability 1; an empty table gives an empty result.
    Rows that repeat a doc_id count and are scored one by one; other columns are ignored. least: occurrences of a context
    and of each of its entries, whatever the corpus. split: occurrences of a context that one part looks at. Only three
    sums go to the driver.
    """
    spark = docs.sparkSession
    blocks_at = table_path(spark, "lm")
    blocks = to_blocks(docs.select("doc_id", "text", train.alias("mark")), splitter, "lm", BLOCK, blocks_at)
    found = blocks.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)), F.count("*")).first()
    tokens, n_blocks = int(found[0] or 0), found[1]

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many words the part has; then each block's totals and symbols."""
        held = defaultdict(list)
        for part, block, nos, words, counts in opened(batches):
            held[part].append((block, nos, words, counts))
        for part, rows in held.items():
            own = Numbers()
            rows = [(block, nos, np.fromiter(map(own.__getitem__, words), np.int64, len(words)), counts) for block, nos, words, counts in rows]
            total, having = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            for _, _, at, counts in rows:
                total[at] += counts  # a block has a word once
                having[at] += 1
            end = own.get(END)
            frequent = total >= least
            if end is not None:
                frequent[end] = True
            symbol = np.zeros(len(own), np.int64)  # by frequency, from 1; 0 for rare words
            symbol[np.argsort(np.where(frequent, -total, 1), kind="stable")] = np.arange(len(own)) + 1
            symbol[~frequent] = 0
            yield _batch((part, -1 - part, None, None, None, None if end is None else int(symbol[end]) - 1, int((total > 0).sum())), TOTALS)
            for block, nos, at, _ in rows:
                yield _batch((part, block, nos, pressed(2 * total[at] + (having[at] == 1)), packed(symbol[at]), None, None), TOTALS)

    parts_ = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_blocks // 5)
    counted = dealt(blocks, parts_).mapInArrow(trimmed(totals), TOTALS)
    places = [table_path(spark, name) for name in ("lm_words", "lm_rows")]
    counted = written_by(counted.groupBy("block").agg(F.collect_list(F.struct("part", "nos", "c", "symbol", "end_at", "known")).alias("found")), "lm_words", "block", places[0])
    own = counted.where("block < 0").select(F.explode("found").alias("f")).select("f.*")
    known, end = own.agg(F.sum("known"), F.max(F.struct("end_at", "part"))).first()
    # a word's number in the corpus is its rank in its part times the number of parts, and its part: small ones are frequent
    known, end = known or 0, end["end_at"] * parts_ + end["part"] if end else 0
    rows = blocks.select("block", "doc_ids", "marks", "sizes", "at").join(counted.hint("merge"), "block").select("block", "doc_ids", "marks", "sizes", "at", "found")
    rows = written_by(rows, "lm_rows", "block", places[1])
    remove(spark, blocks_at, places[0])  # all that later steps read is in lm_rows
    freed(spark)
    base = np.log10(tokens + 0.5 * (known + 1))
    rule = Rule(least, discount, strictness, tokens)

    def opened_blocks(batches: Iterator[pa.RecordBatch], depths: int):
        """Each block's number, documents and tokens, and the block with its tree of so many depths."""
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = np.asarray(batch[3][i].values, np.int64)
                starts, at = by_document(sizes), unpacked(batch[4][i].as_py())
                found = [(x["part"], np.cumsum(unpacked(x["nos"])), loose(x["c"], "<i8"), unpacked(x["symbol"])) for x in batch[5][i].as_py()]
                c = np.zeros(sum(len(x[1]) for x in found), np.int64)
                word, lone = np.full(len(c), -1, np.int64), np.zeros(len(c), bool)
                for part, nos, n, s in found:
                    c[nos], lone[nos] = n >> 1, n & 1
                    word[nos[s > 0]] = (s[s > 0] - 1) * parts_ + part
                rising = np.argsort(word, kind="stable")
                place = np.empty(len(word), np.int64)
                place[rising] = np.arange(len(word))
                at, c, word, lone = place[at], c[rising], word[rising], lone[rising]
                first = np.zeros(len(at), bool)
                first[starts[:-1]] = True
                marks = batch[2][i].values.to_numpy(zero_copy_only=False).astype(bool)
                symbol = np.where(word >= 0, np.arange(len(word)), -1)[at]
                block = planted(symbol, first, np.repeat(marks, sizes), word.view(np.uint64), c, lone, int(np.flatnonzero(word == end)[0]), ((c + 0.5) / 10.0**base)[at], rule.fewest)
                for d in range(depths):
                    replies = {x["part"]: (loose(x["counts"], "<i8"), v := loose(x["verdicts"], "u1"), heard(v, loose(x["sums"], "<f8"))) for x in batch[6 + d][i].as_py() or []}
                    deepened(block, question(block, parts_, split), replies, rule)
                yield batch[0][i].as_py(), batch[1][i].values, sizes, starts, at, c, block
                del found, at, c, word, lone, rising, place, symbol, first, block  # before the next block is made

    for d in range(depth):

        def ask(batches: Iterator[pa.RecordBatch], d=d) -> Iterator[pa.RecordBatch]:
            for number, *_, block in opened_blocks(batches, d):
                for part, names, *values in sent(block, question(block, parts_, split)):
                    yield _batch((part, number, together(names), *map(pressed, values)), QUESTIONS)
                del _, block

        def judge(batches: Iterator[pa.RecordBatch], d=d) -> Iterator[pa.RecordBatch]:
            held = defaultdict(list)
            kinds = ("<i4", "<i4", "<i4", "<i4", "<u8", "<i4", "<u2")
            for batch in batches:
                for part, number, *values in zip(*(c.to_pylist() for c in batch.columns)):
                    held[part].append((number, values))
            for part in list(held):
                asked = []
                for number, (names, *values) in held.pop(part):
                    rest, split_number, splits, runs, word, n, shorter = (loose(x, t) for x, t in zip(values, kinds))
                    word = climbed(word, begins(runs))
                    key = named(apart(names, "<u8"), split_number, d < SPELLED)
                    asked.append((number, (key, rest, splits, runs, word, n, lengthened(shorter, word, n, d + 1))))
                own, verdict, sums = judged(*(np.concatenate([v[k] for _, v in asked]) for k in range(7)), rule)
                a = b = 0
                for number, values in asked:
                    m, k = len(values[0]), len(values[4])
                    yield _batch((part, number, pressed(own[b : b + k].astype("<i8")), pressed(verdict[a : a + m]), pressed(told(verdict[a : a + m], sums[a : a + m]).astype("<f8"))), REPLIES)
                    a, b = a + m, b + k

        asked = rows.mapInArrow(trimmed(ask), QUESTIONS).repartition(parts_, "part")
        replies = asked.mapInArrow(trimmed(judge), REPLIES).groupBy("block").agg(F.collect_list(F.struct("part", "counts", "verdicts", "sums")).alias(f"replies{d}"))
        rows = rows.join(written_by(replies, f"lm_replies{d}", "block").hint("merge"), "block", "left")
        freed(spark)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, sizes, starts, at, c, block in opened_blocks(batches, depth):
            sums = [np.add.reduceat(x, starts[:-1]) for x in ((c > 0).astype(np.int64)[at], (np.log10(c + 0.5) - base)[at], np.log10(block.p))]
            columns = [ids, pa.array(sizes, pa.int64()), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
            del at, c, block

    out = rows.mapInArrow(trimmed(scored), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
