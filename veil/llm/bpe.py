r"""Byte-level BPE by rank-synchronous merging of ragged numpy arrays.

Texts are cut into pre-tokens with array operations over character classes. Pre-tokens not met before are laid out as
one ragged array of symbols; in each round every pre-token merges its pair of lowest rank, everywhere it occurs and
all pre-tokens at once, until none has a pair left. As each merge of the vocabulary makes a symbol of its own, a
merge never makes a pair of lower rank, so this equals merging one pair at a time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import regex

SENTINEL = "￿"
NONE = np.int32(2**31 - 1)
#: Characters cut at once, pre-tokens merged at once, and pre-tokens remembered by a worker.
CHUNK, MERGED_AT_ONCE, REMEMBERED = 1 << 20, 1 << 16, 1 << 18

LETTER, NUMBER, SPACE, BOUNDARY = 1, 2, 3, 4
_classes: np.ndarray | None = None
_memories: dict[tuple, dict] = {}


@dataclass(frozen=True)
class Vocabulary:
    """Arrays of a byte-level BPE vocabulary. `keys` is sorted: two symbols of 16 bits each."""

    name: str
    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    specials: tuple[str, ...]


def load(path: str) -> Vocabulary:
    """Reads the vocabulary file of a byte-level BPE (`tokenizers` JSON)."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    vocab = data["model"]["vocab"]
    # the alphabet of byte-level BPE: printable bytes stand for themselves, the others for characters from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    byte_ids = np.array([vocab[chr(b if b in plain else next(shifted))] for b in range(256)], np.uint16)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
    keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
    order = np.argsort(keys)
    merged = np.array([vocab[a + b] for a, b in pairs], np.uint16)
    specials = tuple(t["content"] for t in data.get("added_tokens", []))
    return Vocabulary(path, byte_ids, keys[order], order.astype(np.int32), merged[order], specials)


def character_classes() -> np.ndarray:
    """Letter, number, space or other of every code point."""
    global _classes
    if _classes is None:
        found = np.zeros(0x110000, np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                found[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
        _classes = found
    return _classes


def pretokens(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """Pre-tokens of all texts in a row, each text closed by a sentinel, and the sentinels' places in that list."""
    joined = SENTINEL.join(texts) + SENTINEL
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = character_classes()[points]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind[ends] = BOUNDARY
    start = np.ones(len(points), bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[ends] = True
    # the last of a run of spaces before other characters stands alone; a blank goes to what follows
    after = 1 + np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != BOUNDARY))
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    # contractions: an apostrophe that begins a pre-token, alone before letters
    quote = np.flatnonzero(points[:-1] == 39)
    quote = quote[start[quote] & (kind[quote + 1] == LETTER)]
    one, two = points[quote + 1], points[np.minimum(quote + 2, len(points) - 1)]
    short = quote[np.isin(one, [ord(c) for c in "stmd"])]
    start[short + 1], start[short + 2] = False, True
    long = quote[((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))]
    start[long + 1], start[long + 3] = False, True

    octets = np.frombuffer(joined.encode("utf-8", "replace"), np.uint8)
    at = np.flatnonzero((octets & 0xC0) != 0x80)[start]
    marked = np.full(len(octets) + len(at) - 1, 255, np.uint8)
    keep = np.ones(len(marked), bool)
    keep[at[1:] + np.arange(len(at) - 1)] = False
    marked[keep] = octets
    return marked.tobytes().split(b"\xff"), np.cumsum(start)[ends] - 1


def _ranks(v: Vocabulary, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(v.keys, keys), len(v.keys) - 1)
    known = v.keys[place] == keys
    return np.where(known, v.ranks[place], NONE), place


def merge(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all pre-tokens (none may be empty) after all merges, in a row, and the number of symbols of each."""
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    symbols = v.byte_ids[np.frombuffer(b"".join(words), np.uint8)].astype(np.uint32)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    rank = np.full(len(symbols), NONE, np.int32)
    place = np.zeros(len(symbols), np.int32)
    fresh = np.arange(len(symbols))
    counts = np.zeros(len(words), np.int64)
    finished: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        # pairs that are new: (i, i + 1) within one pre-token
        rank[fresh] = NONE
        inner = fresh[fresh + 1 < len(symbols)]
        inner = inner[owner[inner] == owner[inner + 1]]
        rank[inner], place[inner] = _ranks(v, symbols[inner] << np.uint32(16) | symbols[inner + 1])
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        size = np.diff(np.r_[first, len(owner)])
        least = np.minimum.reduceat(rank, first)
        done = least == NONE
        if done.any():
            rest = np.repeat(~done, size)
            counts[owner[first[done]]] = size[done]
            finished.append((owner[~rest], symbols[~rest].astype(np.uint16)))
            symbols, owner, rank, place = symbols[rest], owner[rest], rank[rest], place[rest]
            size, least = size[~done], least[~done]
            if not len(symbols):
                break
        hit = np.flatnonzero(rank == np.repeat(least, size))
        # in a run of overlapping pairs every other one merges, from the left
        gap = np.diff(hit) != 1
        if not gap.all():
            begin = np.flatnonzero(np.r_[True, gap])
            hit = hit[(np.arange(len(hit)) - begin[np.cumsum(np.r_[False, gap])]) % 2 == 0]
        symbols[hit] = v.merged[place[hit]]
        rest = np.ones(len(symbols), bool)
        rest[hit + 1] = False
        moved = hit - np.arange(len(hit))
        symbols, owner, rank, place = symbols[rest], owner[rest], rank[rest], place[rest]
        fresh = np.concatenate([moved, moved[moved > 0] - 1])
    if not finished:
        return np.zeros(0, np.uint16), counts
    owners, out = (np.concatenate(x) for x in zip(*finished))
    return out[np.argsort(owners, kind="stable")], counts


def lengths(symbols: np.ndarray, counts: np.ndarray) -> list[int]:
    return counts.tolist()


def packed(symbols: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Symbols of each pre-token as little-endian 16-bit numbers."""
    data, ends = symbols.astype("<u2").tobytes(), (2 * np.cumsum(counts)).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _values(v: Vocabulary, words: list[bytes], values) -> list:
    """What `values` makes of the symbols of each pre-token. Memory that is full learns no more."""
    memory = _memories.setdefault((v.name, values), {})
    found = list(map(memory.get, words))
    places = [i for i, x in enumerate(found) if x is None]
    if not places:
        return found
    missing, fresh = list({words[i] for i in places}), {}
    for at in range(0, len(missing), MERGED_AT_ONCE):
        part = missing[at : at + MERGED_AT_ONCE]
        fresh.update(zip(part, values(*merge(v, part))))
    for i in places:
        found[i] = fresh[words[i]]
    if len(memory) + len(fresh) <= REMEMBERED:
        memory.update(fresh)
    return found


def _chunks(texts: list[str], specials: tuple[str, ...]):
    """Lists of (text number, piece) of about CHUNK characters; special strings cut texts, and count as `None` pieces."""
    pattern = regex.compile("|".join(map(regex.escape, specials))) if specials else None
    chunk, size = [], 0
    for i, text in enumerate(texts):
        found = list(pattern.finditer(text)) if pattern else []
        at = 0
        for m in [*found, None]:
            piece = text[at : m.start() if m else len(text)]
            if piece:
                chunk.append((i, piece))
                size += len(piece)
            if m:
                chunk.append((i, None))
                at = m.end()
            if size >= CHUNK:
                yield chunk
                chunk, size = [], 0
    if chunk:
        yield chunk


def count(v: Vocabulary, texts: list[str], specials: bool = True) -> np.ndarray:
    """Number of tokens of each text. specials: the vocabulary's special strings count as one token each."""
    out = np.zeros(len(texts), np.int64)
    for chunk in _chunks(texts, v.specials if specials else ()):
        np.add.at(out, [i for i, piece in chunk if piece is None], 1)
        owners = [i for i, piece in chunk if piece is not None]
        if not owners:
            continue
        words, ends = pretokens([piece for _, piece in chunk if piece is not None])
        counts = np.array(_values(v, words, lengths), np.int64)
        counts[ends] = 0
        np.add.at(out, owners, np.add.reduceat(counts, np.r_[0, ends[:-1] + 1]))
    return out


def encode(v: Vocabulary, texts: list[str]) -> list[bytes]:
    """Token ids of each text as little-endian 16-bit numbers; special strings are ordinary text."""
    parts: list[list[bytes]] = [[] for _ in texts]
    for chunk in _chunks(texts, ()):
        words, ends = pretokens([piece for _, piece in chunk])
        ids = _values(v, words, packed)
        for (i, _), a, b in zip(chunk, np.r_[0, ends[:-1] + 1].tolist(), ends.tolist()):
            parts[i].append(b"".join(ids[a:b]))
    return [b"".join(p) for p in parts]
