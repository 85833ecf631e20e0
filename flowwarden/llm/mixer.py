"""Language-model scores: bit predictors over hashed contexts, mixed by gated weights and refined.

A token of a text is coded bit by bit, given the tokens before it.  A token that is not among the
frequent words is one symbol there, and is then spelled by a second model of the same kind over bytes.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.text import materialize, mix64, text_of

ORDERS = (0, 1, 2, 3, 4, 6)
SLOT_BITS = 19
SLOTS = 1 << SLOT_BITS
BLOCK = 1 << 16
BLOCK_BYTES = 1 << 18
WORDS_KEPT = 200_000
HEAD_WORDS = 1 << 17
ROWS_AT_ONCE = 50_000
RATE = 0.005
FIRST_WEIGHT = 0.15
STEP_BITS = 2048
PLACES = 8
GATES = (len(ORDERS) + 1, PLACES * 8)
REFINE_CONTEXTS, REFINE_STEPS = 256, 33
STOP = 32
SMOOTH = 0.1
# Of the model of tokens: contexts are the node alone, and after the last one, two and three tokens.
TOKEN_ORDERS = 4
LEAST_SLOT_BITS, MOST_SLOT_BITS = 14, 20
TOKENS_AT_ONCE, TOKENS_IN_CACHE = 1 << 14, 1 << 11
LEVELS = 32
TOKEN_STEP_BITS = 4096
TOKEN_GATES = (TOKEN_ORDERS, LEVELS)
TOKEN_CELLS = TOKEN_ORDERS * LEVELS * REFINE_STEPS * 2
HEAD_LEAST = 2


# --- how a word becomes bits ---------------------------------------------------------
def _blocks(words: list[bytes]):
    """Runs of words of about one block of bytes; a longer word is a block of its own."""
    begin = held = 0
    for i, w in enumerate(words):
        held += len(w) + 1
        if held >= BLOCK_BYTES:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(words):
        yield begin, len(words)


def _contexts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of words, each ended by a stop byte: the bytes, their word, their place in it, and a hash per context order."""
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    size = np.array([len(w) + 1 for w in words])
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(over="ignore"):
        own = mix64(np.minimum(place, 15).astype(np.uint64) + np.uint64(1000))
        out, at = [own], np.full(len(data), np.uint64(7))
        for back in range(1, max(ORDERS) + 1):
            before = np.concatenate([np.zeros(back, np.uint64), data[:-back].astype(np.uint64) + np.uint64(1)])[:len(data)]
            at = mix64(at + np.where(place >= back, before, np.uint64(0)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(back))
            if back in ORDERS:
                out.append(at)
    return data, word, place, out


@dataclass
class Code:
    """A prefix code of all bytes: frequent ones have few bits, so few predictions."""

    nodes: np.ndarray  # byte x depth: the inner node at which the bit is decided, -1 past the end
    bits: np.ndarray   # byte x depth


def byte_code(counts: np.ndarray) -> Code:
    """Huffman code of the byte counts; every byte gets a code."""
    heap = [(int(c) + 1, b, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    child: dict[int, tuple[int, int]] = {}
    following = 256
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        child[following] = (x, y)
        heapq.heappush(heap, (a + b, following, following))
        following += 1
    path: dict[int, list[tuple[int, int]]] = {following - 1: []}
    for inner in range(following - 1, 255, -1):
        for bit, below in enumerate(child[inner]):
            path[below] = [*path[inner], (inner - 256, bit)]
    depth = max(len(path[b]) for b in range(256))
    nodes, bits = np.full((256, depth), -1), np.zeros((256, depth), np.int64)
    for b in range(256):
        for k, (node, bit) in enumerate(path[b]):
            nodes[b, k], bits[b, k] = node, bit
    return Code(nodes, bits)


def _bits(words: list[bytes], code: Code):
    """Per depth of the byte code: the bit, its node, its word, its place, and its slot per order."""
    data, word, place, contexts = _contexts(words)
    for depth in range(code.nodes.shape[1]):
        node = code.nodes[data, depth]
        live = node >= 0
        if not live.all():
            data, word, place, node = data[live], word[live], place[live], node[live]
            contexts = [c[live] for c in contexts]
        if not len(data):
            return
        with np.errstate(over="ignore"):
            at = (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            slots = [(mix64(c + at) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for c in contexts]
        yield code.bits[data, depth], node, word, place, slots, min(depth, 7)


@dataclass
class Mixer:
    """The byte code, bit counts by order and slot, gated weights, and the refining table."""

    code: Code
    counts: np.ndarray            # orders x slots x 2
    gates: list[np.ndarray]
    refined: np.ndarray           # contexts x steps: probability of a one


def _stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


def _inputs(counts: np.ndarray, slots: list[np.ndarray], own: np.ndarray | None, node: np.ndarray, place: np.ndarray, level: int):
    """What the predictors say, and which weights are to be used.  ``own``: the bit, to be left out of the counts."""
    both = [counts[k].take(s, axis=0) for k, s in enumerate(slots)]
    ones = np.stack([x[:, 1] for x in both]).astype(np.float32)
    zeros = np.stack([x[:, 0] for x in both]).astype(np.float32)
    if own is not None:
        ones -= own
        zeros -= 1 - own
        np.maximum(ones, 0, out=ones)
        np.maximum(zeros, 0, out=zeros)
    say = np.log((ones + 0.2) / (zeros + 0.2))
    depth = ((ones + zeros) > 0).sum(axis=0)
    return say, (depth, np.minimum(place, PLACES - 1) * 8 + level)


def _mixed(gates: list[np.ndarray], say: np.ndarray, chosen) -> np.ndarray:
    return sum((g[c].T * say).sum(axis=0) for g, c in zip(gates, chosen))


def _cell(x: np.ndarray) -> np.ndarray:
    return np.rint((np.clip(x, -8, 8) + 8) * (REFINE_STEPS - 1) / 16).astype(np.int64)


def _start() -> list[np.ndarray]:
    return [np.full((n, len(ORDERS)), FIRST_WEIGHT) for n in GATES]


# --- learning, distributed -----------------------------------------------------------
def _packed(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: the low bytes of small counts are zero, and pack to nothing when stored."""
    return values.astype(np.float32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(held: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(held, np.uint8).reshape(4, -1).T).view(np.float32).reshape(-1)


def _sum_blocks(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, more in zip(batch.column("block").to_pylist(), batch.column("held")):
            values = _unpacked(more.as_py())
            held[b] = held[b] + values if b in held else values.astype(np.float64)
    for b, values in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_packed(values)], pa.binary())], ["block", "held"])


def _as_blocks(flat: np.ndarray):
    for b in range(-(-len(flat) // BLOCK)):
        part = flat[b * BLOCK:(b + 1) * BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_packed(part)], pa.binary())], ["block", "held"])


def _summed(rows: DataFrame, work, size: int) -> np.ndarray:
    """The sum over partitions of a fixed-size array that ``work`` makes of each."""
    blocks = rows.mapInArrow(work, "block int, held binary").repartition("block").mapInArrow(_sum_blocks, "block int, held binary")
    out = np.zeros(-(-size // BLOCK) * BLOCK, np.float32)
    for b, held in materialize(blocks, "sums").toLocalIterator():
        values = _unpacked(held)
        out[b * BLOCK:b * BLOCK + len(values)] = values
    return out[:size]


def _bytes(batches):
    counts = np.zeros(256, np.float64)
    for batch in batches:
        for begin, end in _blocks(words := batch.column("word").to_pylist()):
            counts += np.bincount(np.frombuffer(b" ".join(words[begin:end]) + b" ", np.uint8), minlength=256)
    yield from _as_blocks(counts)


def _count(batches, code: Code):
    counts = np.zeros((len(ORDERS), SLOTS * 2), np.uint32)
    for batch in batches:
        words = batch.column("word").to_pylist()
        for begin, end in _blocks(words):
            for bit, _, _, _, slots, _ in _bits(words[begin:end], code):
                for k, s in enumerate(slots):
                    np.add.at(counts[k], s * 2 + bit, np.uint32(1))
    yield from _as_blocks(counts.reshape(-1))


def _learn(batches, shared, code: Code):
    """Online: the weights follow the error of each small step; the refining table counts along."""
    gates, refine, n = _start(), np.zeros(REFINE_CONTEXTS * REFINE_STEPS * 2), 0
    for batch in batches:
        words = batch.column("word").to_pylist()
        for begin, end in _blocks(words):
            for bit, node, _, place, slots, level in _bits(words[begin:end], code):
                say, chosen = _inputs(shared.value, slots, bit, node, place, level)
                for at in range(0, len(bit), STEP_BITS):
                    part = slice(at, at + STEP_BITS)
                    x = _mixed(gates, say[:, part], [c[part] for c in chosen])
                    error = bit[part] - _squash(x)
                    np.add.at(refine, (node[part] * REFINE_STEPS + _cell(x)) * 2 + bit[part], 1.0)
                    slope = error * say[:, part]
                    for g, c in zip(gates, chosen):
                        push = np.stack([np.bincount(c[part], s, len(g)) for s in slope], axis=1)
                        seen = np.bincount(c[part], minlength=len(g))[:, None]
                        g += RATE * push / np.sqrt(np.maximum(seen, 1))
                    n += len(error)
    if n:
        yield from _as_blocks(np.concatenate([[n], *(n * g.reshape(-1) for g in gates), refine]))


def learn(vocabulary: DataFrame) -> Mixer:
    """Learns the bit model from the distinct training words (column ``word``), each once.

    Steps, each a sum over partitions of arrays of fixed size: byte counts, from
    which the bytes get a prefix code; bit counts by
    hashed context; mixing weights, learned online in every partition (a word is
    left out of the counts that predict it) and averaged by bits seen; the
    refining table, which corrects the mixed probability by node and step.
    """
    words = vocabulary.select("word")
    code = byte_code(_summed(words, _bytes, 256))
    counts = _summed(words, partial(_count, code=code), len(ORDERS) * SLOTS * 2)
    counts = counts.reshape(len(ORDERS), SLOTS, 2)
    shared = vocabulary.sparkSession.sparkContext.broadcast(counts)
    sizes = [n * len(ORDERS) for n in GATES]
    flat = _summed(words, partial(_learn, shared=shared, code=code), 1 + sum(sizes) + REFINE_CONTEXTS * REFINE_STEPS * 2)
    gates, at = [], 1
    for n, size, start in zip(GATES, sizes, _start()):
        gates.append(flat[at:at + size].reshape(n, -1) / flat[0] if flat[0] else start)
        at += size
    refine = flat[at:].reshape(REFINE_CONTEXTS, REFINE_STEPS, 2).astype(np.float64)
    middle = _squash(np.linspace(-8, 8, REFINE_STEPS))
    refined = (refine[:, :, 1] + 8 * middle) / (refine.sum(axis=2) + 8)
    return Mixer(code, counts, gates, refined)


def spelled(model: Mixer, words: list[bytes]) -> np.ndarray:
    """log10 of the probability of each word's bytes and its stop."""
    out = np.zeros(len(words))
    for begin, end in _blocks(words):
        for bit, node, word, place, slots, level in _bits(words[begin:end], model.code):
            say, chosen = _inputs(model.counts, slots, None, node, place, level)
            x = _mixed(model.gates, say, chosen)
            p = np.clip((_squash(x) + model.refined[node, _cell(x)]) / 2, 1e-6, 1 - 1e-6)
            out[begin:end] += np.bincount(word, np.log10(np.where(bit == 1, p, 1 - p)), end - begin)
    return out


# --- words of the corpus -------------------------------------------------------------
def _words(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()


def _vocabulary(batches):
    """Words with their training counts, summed within chunks of the partition.  The end of a text is the empty word."""
    held: Counter = Counter()

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

    for batch in batches:
        for train, text in zip(batch.column("train").to_pylist(), batch.column("text")):
            words = _words(text.as_py())
            words.append(b"")
            if train:
                held.update(words)
            else:
                for w in words:
                    if w not in held:
                        held[w] = 0
            if len(held) >= WORDS_KEPT:
                yield flush()
                held.clear()
    if held:
        yield flush()


# --- tokens of whole texts ------------------------------------------------------------
@dataclass
class TokenCode:
    """A prefix code of the frequent words and, as the last symbol, of all others: the inner nodes and bits of one after the other."""

    first: np.ndarray   # by symbol, where its path starts
    size: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    marks: np.ndarray   # a hash per inner node

    @property
    def other(self) -> int:
        return len(self.size) - 1


def token_code(counts: np.ndarray) -> TokenCode:
    """Huffman code of the counts; a symbol without any gets a code too."""
    n = len(counts)
    above, side, depth = np.full(2 * n - 1, -1), np.zeros(2 * n - 1, np.int8), np.zeros(2 * n - 1, np.int64)
    heap = [(int(c) + 1, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    for inner in range(n, 2 * n - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        above[x], above[y], side[y] = inner, inner, 1
        heapq.heappush(heap, (a + b, inner))
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[above[i]] + 1
    size = depth[:n].copy()
    first = np.cumsum(size) - size
    nodes, bits = np.zeros(size.sum(), np.int32), np.zeros(size.sum(), np.int8)
    symbol = at = np.arange(n)
    for up in range(1, size.max() + 1):
        symbol, at = symbol[size[symbol] >= up], at[size[symbol] >= up]
        place = first[symbol] + size[symbol] - up
        nodes[place], bits[place] = above[at] - n, side[at]
        at = above[at]
    return TokenCode(first, size, nodes, bits, (mix64(np.arange(1, max(n, 2), dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32))


def _identities(words: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """Of frequent words the rank, of others a negative hash, so that they too are a context."""
    return [ranks[w] if w in ranks else -1 - zlib.crc32(w) for w in words]


def _before(same: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """A hash of the last one, two, three tokens of the text, where ``place`` counts the tokens from its start."""
    held, out = np.full(len(same), 11, np.uint64), []
    with np.errstate(over="ignore"):
        for back in range(1, TOKEN_ORDERS):
            prior = np.concatenate([np.zeros(back, np.int64), same[:-back]])[:len(same)].view(np.uint64) + np.uint64(1 << 40)
            held = mix64(held + np.where(place >= back, prior, np.uint64(0)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(back))
            out.append((held >> np.uint64(32)).astype(np.uint32))
    return out


def _token_bits(code: TokenCode, same: np.ndarray, place: np.ndarray, slot_bits: int):
    """In runs of tokens, every bit of their codes: its token, bit, place in the code, and its slot per context order."""
    symbol = np.where(same < 0, code.other, same)
    before = _before(same, place)
    for begin in range(0, len(same), TOKENS_IN_CACHE):
        part = slice(begin, begin + TOKENS_IN_CACHE)
        size = code.size.take(symbol[part])
        token = np.repeat(np.arange(len(size)), size)
        level = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
        at = level + np.repeat(code.first.take(symbol[part]), size)
        node = code.nodes.take(at).astype(np.int64)
        mark = code.marks.take(node)
        slots = [node, *(((b[part].take(token) ^ mark) >> np.uint32(32 - slot_bits)).astype(np.int64) for b in before)]
        if len(token):
            yield begin + token, code.bits.take(at).astype(np.int64), np.minimum(level, LEVELS - 1), slots


def _batch_tokens(batch, ranks: dict[bytes, int]):
    """Of runs of texts: (text in batch, its words and end), the identity of each token, its place in its text, its text."""
    held, tokens = [], 0
    for i, text in enumerate(batch.column("text")):
        words = _words(text.as_py())
        words.append(b"")
        held.append((i, words))
        tokens += len(words)
        if tokens >= TOKENS_AT_ONCE or i + 1 == batch.num_rows:
            size = np.array([len(words) for _, words in held])
            same = np.array([x for _, words in held for x in _identities(words, ranks)], np.int64)
            yield held, same, np.arange(len(same)) - np.repeat(np.cumsum(size) - size, size), np.repeat(np.arange(len(held)), size)
            held, tokens = [], 0


def _count_tokens(batches, shared, slot_bits: int):
    code, ranks = shared.value
    counts = np.zeros((TOKEN_ORDERS - 1, 2 << slot_bits), np.uint32)
    for batch in batches:
        for _, same, place, _ in _batch_tokens(batch, ranks):
            for _, bit, _, slots in _token_bits(code, same, place, slot_bits):
                for k, s in enumerate(slots[1:]):
                    np.add.at(counts[k], s * 2 + bit, np.uint32(1))
    yield from _as_blocks(counts.reshape(-1))


def _told(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The log odds that two counts speak for; exactly 0 only where nothing was counted."""
    return np.where(ones + zeros > 0, np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4))) + np.float32(1e-6), np.float32(0))


def _gated(say: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Which gated weights are used: how many contexts are known, and the place in the code."""
    return sum((s != 0).view(np.int8) for s in say[1:]) * np.int64(LEVELS) + level


def _start_tokens() -> list[np.ndarray]:
    """At first the frequency of a token alone speaks."""
    return [np.tile(np.eye(1, TOKEN_ORDERS) / 2, (n, 1)) for n in TOKEN_GATES]


def _both_gates(gates: list[np.ndarray]) -> np.ndarray:
    """Weights by context order, then by known contexts and place."""
    return np.ascontiguousarray((gates[0][:, None, :] + gates[1][None, :, :]).reshape(-1, TOKEN_ORDERS).T.astype(np.float32))


def _weighed(weights: np.ndarray, say: np.ndarray, gate: np.ndarray) -> np.ndarray:
    return sum(w.take(gate) * s for w, s in zip(weights, say))


def _learn_tokens(batches, shared, counted, slot_bits: int):
    """Online as for bytes.  A bit is left out of the counts that predict it."""
    (code, ranks), counts = shared.value, counted.value
    gates, refine, n = _start_tokens(), np.zeros(TOKEN_CELLS), 0
    for batch in batches:
        for _, same, place, _ in _batch_tokens(batch, ranks):
            for _, bit, level, slots in _token_bits(code, same, place, slot_bits):
                own = bit.astype(np.float32)
                both = [c.take(s, axis=0) for c, s in zip(counts, slots)]
                say = np.stack([_told(np.maximum(c[:, 1] - own, 0), np.maximum(c[:, 0] - (1 - own), 0)) for c in both])
                gate = _gated(say, level)
                mixed = []
                for at in range(0, len(bit), TOKEN_STEP_BITS):
                    part = slice(at, at + TOKEN_STEP_BITS)
                    mixed.append(_weighed(_both_gates(gates), say[:, part], gate[part]))
                    error = own[part] - _squash(mixed[-1])
                    # By known contexts, place and order; a gate's own sums are sums of these.
                    push = np.stack([np.bincount(gate[part], error * s, TOKEN_ORDERS * LEVELS) for s in say[:, part]], axis=1).reshape(TOKEN_ORDERS, LEVELS, -1)
                    met = np.bincount(gate[part], minlength=TOKEN_ORDERS * LEVELS).reshape(TOKEN_ORDERS, LEVELS)
                    for g, over in zip(gates, (1, 0)):
                        g += RATE * push.sum(axis=over) / np.sqrt(np.maximum(met.sum(axis=over), 1))[:, None]
                np.add.at(refine, (gate * REFINE_STEPS + _cell(np.concatenate(mixed))) * 2 + bit, 1.0)
                n += len(bit)
    if n:
        yield from _as_blocks(np.concatenate([[n], *(n * g.reshape(-1) for g in gates), refine]))


@dataclass
class TokenMixer:
    """What the predictors say by order and slot, gated weights, and the refining table."""

    told: list[np.ndarray]
    weights: np.ndarray
    refined: np.ndarray   # known contexts and place x steps, flat: probability of a one
    slot_bits: int


def learn_tokens(rows: DataFrame, shared, counts: np.ndarray) -> TokenMixer:
    """Learns the model of tokens from whole texts (column ``text``), given the code and ranks (``shared``) and each symbol's count.

    Steps, each a sum over partitions of arrays of fixed size, as for bytes: bit counts by hashed context (those of the
    node alone are sums of the given counts), then mixing weights and the refining table.
    """
    spark = rows.sparkSession
    code, _ = shared.value
    slot_bits = min(MOST_SLOT_BITS, max(LEAST_SLOT_BITS, int(counts.sum()).bit_length()))
    alone = np.zeros((len(code.marks), 2))
    np.add.at(alone.reshape(-1), code.nodes.astype(np.int64) * 2 + code.bits, np.repeat(counts.astype(float), code.size))
    texts = rows.select("text")
    seen = _summed(texts, partial(_count_tokens, shared=shared, slot_bits=slot_bits), (TOKEN_ORDERS - 1) * (2 << slot_bits))
    held = [alone.astype(np.float32), *seen.reshape(TOKEN_ORDERS - 1, -1, 2)]
    counted = spark.sparkContext.broadcast(held)
    sizes = [n * TOKEN_ORDERS for n in TOKEN_GATES]
    flat = _summed(texts, partial(_learn_tokens, shared=shared, counted=counted, slot_bits=slot_bits), 1 + sum(sizes) + TOKEN_CELLS)
    counted.unpersist()
    gates, at = [], 1
    for n, size, start in zip(TOKEN_GATES, sizes, _start_tokens()):
        gates.append(flat[at:at + size].reshape(n, -1) / flat[0] if flat[0] else start)
        at += size
    refine = flat[at:].reshape(-1, REFINE_STEPS, 2).astype(np.float64)
    refined = (refine[:, :, 1] + 8 * _squash(np.linspace(-8, 8, REFINE_STEPS))) / (refine.sum(axis=2) + 8)
    return TokenMixer([_told(c[:, 1], c[:, 0]) for c in held], _both_gates(gates), refined.reshape(-1).astype(np.float32), slot_bits)


def told(model: TokenMixer, code: TokenCode, same: np.ndarray, place: np.ndarray) -> np.ndarray:
    """log10 of the probability of each token's symbol, given the tokens before it."""
    out = np.zeros(len(same))
    for token, bit, level, slots in _token_bits(code, same, place, model.slot_bits):
        say = np.stack([t.take(s) for t, s in zip(model.told, slots)])
        gate = _gated(say, level)
        x = _weighed(model.weights, say, gate)
        p = np.clip((_squash(x) + model.refined.take(gate * REFINE_STEPS + _cell(x))) / 2, 1e-5, 1 - 1e-5)
        begin = token[0]
        found = np.bincount(token - begin, np.log(np.where(bit == 1, p, 1 - p))) / np.log(10)
        out[begin:begin + len(found)] += found
    return out


def _word_scores(batches, shared, ranks, n_tokens: int, n_words: int, rest: tuple[int, int], discount: float):
    """The base score of each word but the frequent ones, and its score as one of these others (``rest``: their tokens and words)."""
    base_of = np.log10(n_tokens + SMOOTH * (n_words + 1))
    n_rest, n_other = rest
    _, frequent = ranks.value
    for batch in batches:
        batch = batch.filter(pa.array([w not in frequent for w in batch.column("word").to_pylist()], pa.bool_()))
        words, c = batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(np.float64)
        spell = spelled(shared.value, words)
        if n_rest:
            own = np.log10(np.maximum(c - discount, 1e-300) / n_rest)
            back = np.log10(discount * n_other / n_rest) + spell
            score = np.maximum(own, back) + np.log10(1 + 10.0 ** -np.abs(own - back))
        else:
            score = spell
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(np.log10(c + SMOOTH) - base_of), pa.array(score)],
                                         ["word", "c", "base", "score"])


def _per_text(batches, shared, model, base):
    """A row of sums over the tokens of each text, and a row per word of it that is not frequent."""
    code, ranks = shared.value
    base = base.value

    def flush(batch):
        at = pa.array(index, pa.int64())
        cols = list(zip(*sums))
        return pa.RecordBatch.from_arrays([
            batch.column("id").take(at), batch.column("h").take(at), pa.array(word, pa.binary()), pa.array(times, pa.int64()),
            *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.float64()) for c in cols[4:])],
            ["id", "h", "word", "times", "rows", "n_tokens", "n_bytes", "n_known", "base", "score"])

    for batch in batches:
        index, word, times, sums = [], [], [], []
        for texts, same, place, text in _batch_tokens(batch, ranks):
            known = np.bincount(text, same >= 0, len(texts)).astype(np.int64)
            bases = np.bincount(text, base.take(np.where(same < 0, code.other, same)), len(texts))
            scores = np.bincount(text, told(model.value, code, same, place), len(texts))
            for (i, words), n, b, s in zip(texts, known.tolist(), bases.tolist(), scores.tolist()):
                if n < len(words):
                    for w, many in Counter(w for w in words if w not in ranks).items():
                        index.append(i)
                        word.append(w)
                        times.append(many)
                        sums.append((0, 0, 0, 0, 0.0, 0.0))
                # No word holds a space, so this key meets nothing in the join and spreads the rows.
                index.append(i)
                word.append(b" %d" % (batch.column("h")[i].as_py() ^ len(words)))
                times.append(0)
                sums.append((1, len(words), sum(map(len, words)) + len(words), n, b, s))
                if len(index) >= ROWS_AT_ONCE:
                    yield flush(batch)
                    index, word, times, sums = [], [], [], []
        if index:
            yield flush(batch)


def lm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS,
              discount: float = 0.75) -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``bits_per_byte``.

    Tokens are the words of the whole text (ASCII lower case) and one end.  Counts
    are taken over all rows where ``train`` holds.  ``base_score`` is the smoothed
    unigram log10 probability.  ``score`` is the model's, over every token of the
    whole text in order.  The token's prefix code is predicted bit by bit from
    hashed contexts of several orders, those of the tokens before it among them,
    mixed by weights that two gates choose (how many contexts are known; place in
    the code), and refined.  The ``head_words`` most frequent training words that
    occur twice at least have a code each (a fixed number, broadcast), all others
    share one: such a word is then one seen in training, by its discounted count,
    or spelled, by a model of the same kind whose contexts are the bytes before.
    ``bits_per_byte`` is the score in bits over the bytes scored.

    What a word costs once it is known to be none of the frequent ones depends on
    the word alone, so it is computed once per distinct word and joined.

    Null text counts as empty and has the end alone.  Repeated rows (same id and
    text) give equal rows.  Without training rows every count is zero and words
    are spelled by untrained predictors.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    vocabulary = materialize(rows.select("text", "train").mapInArrow(_vocabulary, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")
    n_tokens, n_words = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    n_tokens, n_words = int(n_tokens), int(n_words)
    top = vocabulary.where(F.col("c") >= HEAD_LEAST).orderBy(F.col("c").desc(), "word").limit(head_words).toArrow()
    c = top.column("c").to_numpy()
    rest = (n_tokens - int(c.sum()), n_words - len(c))
    counts = np.append(c, rest[0])
    shared = spark.sparkContext.broadcast((token_code(counts), {w: i for i, w in enumerate(top.column("word").to_pylist())}))
    base = spark.sparkContext.broadcast(np.append(np.log10(c + SMOOTH) - np.log10(n_tokens + SMOOTH * (n_words + 1)), 0.0))
    tokens = spark.sparkContext.broadcast(learn_tokens(rows.where("train"), shared, counts))
    model = spark.sparkContext.broadcast(learn(vocabulary.where("c > 0")))
    scored = materialize(vocabulary.mapInArrow(
        partial(_word_scores, shared=model, ranks=shared, n_tokens=n_tokens, n_words=n_words, rest=rest, discount=discount),
        "word binary, c long, base double, score double"), "word-scores")

    kind = rows.schema["id"].dataType.simpleString()
    parts = rows.select("id", F.hash("text").alias("h"), "text").mapInArrow(
        partial(_per_text, shared=shared, model=tokens, base=base),
        f"id {kind}, h int, word binary, times long, rows long, n_tokens long, n_bytes long, n_known long, base double, score double")
    tail = scored.select("word", F.col("c").alias("wc"), F.col("base").alias("wb"), F.col("score").alias("ws"))
    joined = parts.join(tail, "word", "left").groupBy("id", "h").agg(
        F.sum("rows").alias("rows"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_bytes").alias("n_bytes"),
        F.sum(F.col("n_known") + F.when(F.col("wc") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.coalesce(F.col("times") * F.col("wb"), F.lit(0.0))).alias("base"),
        F.sum(F.col("score") + F.coalesce(F.col("times") * F.col("ws"), F.lit(0.0))).alias("score"))

    def per_row(name: str) -> Column:
        return F.expr(f"{name} div rows") if name.startswith("n_") else F.col(name) / F.col("rows")

    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select(
        F.col("id").alias(id_col), per_row("n_tokens").alias("n_tokens"), per_row("n_known").alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"), per_row("base").alias("base_score"), per_row("score").alias("score"),
        (-per_row("score") * float(np.log2(10)) / per_row("n_bytes")).alias("bits_per_byte"))
