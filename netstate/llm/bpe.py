"""Byte-level BPE by an automaton over tokens, compiled merge by merge.

The automaton has a state for each token, the last one read, and an arc s -u-> u if the tokens s u may stand side by side in
an encoding. It starts with the 256 bytes, all arcs present. The gadget of a merge a b -> c

* adds state c, whose outgoing arcs are those that b has at that time;
* gives every state with an arc a, c among them, an arc c as well (if a = b, not state a);
* takes the arc b away from state a.

So an arc (s, u) never needs to be stored: it was copied from (s, first part of u) when u came later than s, else from (last
part of s, u), down to two bytes, and must not have been taken away by a merge older than the copy. ``Automaton.arc``
looks it up in the tables ``parts`` and ``taken``, which the gadgets fill, and keeps what it has found in the transition table.

A prefix of a word is spelled by at most one path from the start. Encoding takes the longest token that is spelled at a place, then
shorter ones until there is an arc to one, and steps back where there is none; a place left that way is never entered again, as the
path to it is the only one. Arc labels along the path spell the text again.
"""
from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how texts are split before merges apply, as published with the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED, ARCS = 200_000, 1_000_000
ENCODED = "doc_id bigint, part int, ids array<int>"


def printable() -> dict[str, int]:
    """The vocabulary writes each byte as a character: itself if it is visible in Latin-1, else from U+0100 upwards."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled from the text of a vocabulary file with byte-level merges and special tokens."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        byte_of = printable()
        spelled = {token: bytes(byte_of[c] for c in token) for token in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        self.labels = {i: spelled[token] for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels |= {i: t.encode() for t, i in self.special.items()}
        self.born = {i: -1 for token, i in ids.items() if len(spelled[token]) == 1}
        self.parts: dict[int, tuple[int, int]] = {}
        self.taken: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self._gadget(rank, ids[a], ids[b], ids[a + b])
        self.shorter: dict[int, int] = {}
        self.trie = self._trie()
        self.heads = {bytes((x, y, z)): (node, node.get(-1, two.get(-1, one[-1])))
                      for x, one in self.trie.items() for y, two in one.items() if y >= 0 for z, node in two.items() if z >= 0}
        self.size = {i: len(label) for i, label in self.labels.items()}
        self.table: dict[int, bool] = {}

    def _gadget(self, rank: int, a: int, b: int, c: int) -> None:
        self.taken.setdefault((a, b), rank)
        if c not in self.born:
            self.born[c] = rank
            self.parts[c] = (a, b)

    def _trie(self) -> dict:
        """Nodes are dicts from byte to node; the token that ends at a node is under -1. ``shorter`` gets the longest token that
        is a proper beginning of each token."""
        root: dict = {}
        for token in sorted(self.born, key=lambda t: len(self.labels[t])):
            node, begun = root, None
            for byte in self.labels[token]:
                begun = node.get(-1, begun)
                node = node.setdefault(byte, {})
            node[-1] = token
            if begun is not None:
                self.shorter[token] = begun
        return root

    def arc(self, s: int, u: int) -> bool:
        """Whether token u may follow token s."""
        known = self.table.get(s << 32 | u)
        if known is None:
            if len(self.table) >= ARCS:                             # memory stays bounded; nothing depends on it
                self.table.clear()
            known = self.table[s << 32 | u] = self._arc_at(s, u, len(self.taken) + 1)
        return known

    def _arc_at(self, s: int, u: int, time: int) -> bool:
        """Whether the arc is there before the gadget of that rank."""
        while True:
            if self.taken.get((s, u), time) < time:
                return False
            bs, bu = self.born[s], self.born[u]
            if bs < 0 and bu < 0:
                return True
            a, b = self.parts.get(u, (u, u))
            if s == u:                                             # state c got its own arc c for the arc a copied from b
                s, u, time = b, a, bu
            elif bu > bs:
                if a == b == s:
                    return False
                u, time = a, bu
            else:
                s, time = self.parts[s][1], bs

    def _longest(self, raw: bytes, place: int) -> int:
        """The longest token that is spelled at the place; every byte is one."""
        node, found = self.heads.get(raw[place:place + 3]) or (None, -1)
        rest = raw[place + 3:]
        if node is None:
            node, rest = self.trie, raw[place:place + 3]
        for byte in rest:
            node = node.get(byte)
            if node is None:
                break
            found = node.get(-1, found)
        return found

    def word(self, raw: bytes) -> list[int]:
        """Tokens of a pre-split word: the one path through the automaton that spells it."""
        n, table, size, longest = len(raw), self.table, self.size, self._longest
        out: list[int] = []
        closed: set[int] = set()
        place, last, u = 0, -1, longest(raw, 0)
        while True:
            end = place + size[u]
            if closed and end in closed:
                known = False
            elif last < 0:
                known = True
            else:
                known = table.get(last << 32 | u)
                if known is None:
                    known = self.arc(last, u)
            if known:
                out.append(u)
                if end == n:
                    return out
                place, last, u = end, u, longest(raw, end)
                continue
            while u not in self.shorter:                            # no arc leads on from here
                closed.add(place)
                u = out.pop()
                place -= size[u]
                last = out[-1] if out else -1
            u = self.shorter[u]


@lru_cache(maxsize=1)
def automaton(vocabulary: str) -> Automaton:
    """One for each worker process."""
    return Automaton(vocabulary)


@lru_cache(maxsize=1)
def spellings(vocabulary: str) -> list[bytes]:
    """Label of each id, special tokens included; nothing is compiled."""
    spec = json.loads(vocabulary)
    byte_of = printable()
    labels = {i: bytes(byte_of[c] for c in token) for token, i in spec["model"]["vocab"].items() if all(c in byte_of for c in token)}
    labels |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [labels.get(i, b"") for i in range(max(labels) + 1)]


class Encoder(dict):
    """Texts to ids. Pieces between a blank and the next are looked up here; a missing one is split into words and encoded.

    Keys are pieces less the blank that they begin with, values their ids as bytes of 32-bit numbers. Of two generations the
    older one is dropped when the younger is full, so memory stays bounded and what comes again is kept; nothing depends on it.
    """

    def __init__(self, automaton: Automaton):
        super().__init__()
        import regex
        self.automaton = automaton
        self.split = regex.compile(SPLIT).findall
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.pieces = re.compile(r"(?= \S)").split
        self.uneven = re.compile(r" (?!\S)").search
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(automaton.special, key=len, reverse=True))) + ")") \
            if automaton.special else None

    def __missing__(self, key: str) -> bytes:
        out = self.older.get(key)
        if out is None:
            out = self._piece(" " + key)
        if 2 * len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        self[key] = out
        return out

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece[1:].isalpha() and piece[0] == " ":
            return self._word(piece)                               # one word by the first rule for letters
        words = self.split(piece)
        if len(words) == 1:
            return self._word(piece)
        return b"".join(map(self._known, words))

    def _known(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= CACHED // 2:
                self.words.clear()
            ids = self.words[word] = self._word(word)
        return ids

    def _word(self, word: str) -> bytes:
        return array("i", self.automaton.word(word.encode())).tobytes()

    def packed(self, text: str) -> bytes:
        """The ids of a text as bytes of 32-bit numbers."""
        out = []
        parts = self.special.split(text) if self.special and any(s in text for s in self.automaton.special) else [text]
        for part in parts:
            if part in self.automaton.special:
                out.append(array("i", [self.automaton.special[part]]).tobytes())
            elif part:
                if self.uneven(part):                               # a blank that begins no piece
                    first, *rest = self.pieces(part)
                    rest = [p[1:] for p in rest]
                    if first[:1] == " " and first[1:2].strip():
                        first, rest = "", [first[1:], *rest]
                else:
                    first, *rest = part.split(" ")
                if first:
                    out.append(self._piece(first))
                out += map(self.__getitem__, rest)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist()


def _vocabulary(docs: DataFrame, path: str) -> str:
    """The text of a vocabulary file of fixed size; a local path or one that Spark reads."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except OSError:
        return docs.sparkSession.read.text(path, wholetext=True).first()[0]


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` rows as doc_id, part and ids of the whole text; null texts have no ids. ``docs``: doc_id, part, text."""
    held = docs.sparkSession.sparkContext.broadcast(_vocabulary(docs, vocabulary))

    def run(batches):
        encoder = Encoder(automaton(held.value))
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                piece = batch.slice(k, 512)
                ids = [encoder.packed(t) if t else b"" for t in piece.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]) // 4
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
                yield pa.record_batch([piece.column("doc_id"), piece.column("part"), lists], names=["doc_id", "part", "ids"])

    return docs.select("doc_id", "part", "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Adds ``decoded``: the labels of the ids, special tokens included, as UTF-8; bytes that are none become U+FFFD."""
    held = encoded.sparkSession.sparkContext.broadcast(_vocabulary(encoded, vocabulary))

    def run(batches):
        table = spellings(held.value)
        for batch in batches:
            lists = batch.column("ids")
            ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
            texts = [b"".join(map(table.__getitem__, ids[a:b].tolist())).decode("utf-8", "replace")
                     for a, b in zip(ends[:-1], ends[1:])]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{ENCODED}, decoded string")


def round_trip_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    from netstate.llm.texts import documents
    both = decode(encode(documents(docs), vocabulary), vocabulary)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
