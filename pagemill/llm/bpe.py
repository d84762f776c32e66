"""BPE encoding and decoding with an automaton over tokens.

`compile_merges` starts from the automaton with one state and a loop for each byte, which accepts
every byte string, and applies one gadget per merge (a, b), in order of rank. The gadget gives the
arcs labelled a a target of their own that lacks the arc b, and adds an arc ab beside every path
a b. What is left accepts one token sequence for every byte string: the one the merges produce.

The target of an arc depends on its label alone, so a state is named by the last token read. A
gadget changes a state only by removing arcs, so a state is kept as its parent, the rank at which
it left the parent, and the arcs removed since. Rows of the transition table are filled from that
when a pre-split word first needs them, and kept.

Encoding walks the table over the tokens that match at each position, longest first, and returns
when the word ends. A position is reached by one valid path at most, so a position that failed is
not tried again, and time is linear in the word. Decoding writes the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pagemill.llm.common import Memo, map_batches

NEVER, TOKEN = 1 << 60, 256

OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, by the public rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled merges: states and removed arcs, the arcs' labels, and a trie to match labels."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], special: dict[str, int], split: str) -> None:
        self.labels, self.special, self.split = labels, special, split
        size = len(labels)
        # The state that an arc leads to is state_of[label]; a state's history is (parent, rank of
        # birth), and removed[state] has the rank at which each arc went.
        self.left, self.right, self.born = [-1] * size, [-1] * size, [0] * size
        self.state_of: list[list[tuple[int, int]]] = [[(0, 0)] for _ in range(size)]
        self.parent, self.since = [-1], [0]
        self.removed: list[dict[int, int]] = [{}]
        # The start state is 0 and counts as a user of it, so its arcs stay.
        users = [size - len(merges) + 1]
        made, self.dead = set(), set()
        for rank, (a, b, ab) in enumerate(merges, 1):
            if ab in made:
                raise ValueError(f"token {ab} is the result of two merges")
            made.add(ab)
            self.left[ab], self.right[ab], self.born[ab] = a, b, rank
            if a in self.dead or not self.has_arc(self.state_of[a][-1][1], b, rank - 1):
                self.dead.add(ab)  # earlier merges leave no path a b
                continue
            before, after = self.state_of[a][-1][1], self.state_of[b][-1][1]
            self.state_of[ab] = [(rank, after)]
            users[after] += 1
            if users[before] > 1:
                users[before] -= 1
                self.parent.append(before)
                self.since.append(rank)
                self.removed.append({})
                users.append(1)
                self.state_of[a].append((rank, len(self.parent) - 1))
                before = len(self.parent) - 1
            self.removed[before][b] = rank
        self.goal = [history[-1][1] for history in self.state_of]
        self.ready()

    def ready(self) -> None:
        """Empty tables; they fill as words need them, within a bound."""
        self.table: dict[int, bool] = {}
        self.trie, self.longest = self._trie(), max(map(len, self.labels))
        self.words = Memo(self._after_space, 300_000)
        self.pieces = Memo(lambda piece: self._pack(self.encode_word(piece.encode())), 60_000)
        self.pattern = regex.compile(self.split)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "trie", "words", "pieces", "pattern")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.ready()

    def _trie(self) -> dict:
        """Nested steps by byte. Under TOKEN a node has the live labels that end on the way to it,
        longest first, as token << 16 | length."""
        root: dict = {TOKEN: ()}
        for token in sorted(set(range(len(self.labels))) - self.dead, key=lambda t: len(self.labels[t])):
            node, label = root, self.labels[token]
            for byte in label:
                if byte not in node:
                    node[byte] = {TOKEN: node[TOKEN]}
                node = node[byte]
            if label:
                node[TOKEN] = (token << 16 | len(label), *node[TOKEN])
        return root

    def has_arc(self, state: int, token: int, at: int = NEVER) -> bool:
        """Whether `state` had an arc `token` after the gadget of rank `at`."""
        if token in self.dead:
            return False
        while True:
            while self.since[state] > at:
                state = self.parent[state]
            if token in self.removed[state] and self.removed[state][token] <= at:
                return False
            born = self.born[token]
            if self.since[state] > born:
                # The state was split off with the arcs its parent had just before.
                at, state = self.since[state] - 1, self.parent[state]
            elif born:
                # The arc was added beside a path left, right: the state had an arc left.
                a, b = self.left[token], self.right[token]
                if a == b and self.removed[state].get(b, NEVER) == born:
                    return False
                token, at = a, born - 1
            else:
                return True

    def follows(self, last: int, token: int) -> bool:
        """Fill one cell of the transition table: whether `token` may follow `last`."""
        if len(self.table) > 500_000:
            self.table.clear()
        known = self.table[last << 20 | token] = self.has_arc(self.goal[last], token)
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """The one accepted path for a pre-split word."""
        size, trie, table = len(word), self.trie, self.table
        path: list[int] = []
        stack: list[tuple] = []  # for each token on the path, where it starts and what else may stand there
        tried = bytearray(size + 1)
        at = 0
        while at < size:
            node = trie
            for byte in word[at : at + self.longest]:
                step = node.get(byte)
                if step is None:
                    break
                node = step
            options = iter(node[TOKEN])
            last = path[-1] << 20 if path else -1
            while True:
                for code in options:
                    end, token = at + (code & 0xFFFF), code >> 16
                    if tried[end]:
                        continue
                    if last >= 0:
                        known = table.get(last | token)
                        if not (self.follows(path[-1], token) if known is None else known):
                            continue
                    break
                else:
                    if not path:
                        raise ValueError("no path; the vocabulary lacks single bytes")
                    path.pop()
                    at, options = stack.pop()
                    last = path[-1] << 20 if path else -1
                    continue
                break
            tried[end] = 1
            path.append(token)
            stack.append((at, options))
            at = end
        return path

    def _pack(self, ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.asarray(ids, "<u4").tobytes()

    def _pieces(self, text: str) -> bytes:
        return b"".join([self.pieces[x] for x in self.pattern.findall(text)])

    def _after_space(self, part: str) -> bytes | None:
        """Ids of a part that stands behind a single space; None if its edges are white space."""
        if not part or part[0].isspace() or part[-1].isspace():
            return None
        return self._pieces(" " + part)

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        A space between two characters that are not white space always starts a pre-split word,
        so the parts between such spaces can be looked up whole.
        """
        if not text:
            return b""
        first, *parts = text.split(" ")
        if not first or first[-1].isspace():
            return self._pieces(text)
        found = list(map(self.words.__getitem__, parts))
        if None in found:
            return self._pieces(text)
        return self._pieces(first) + b"".join(found)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; the strings of special tokens get theirs."""
        if not any(mark in text for mark in self.special):
            return np.frombuffer(self._plain(text), "<u4")
        marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        out, at = [], 0
        for mark in marks.finditer(text):
            out += [self._plain(text[at : mark.start()]), self._pack([self.special[mark[0]]])]
            at = mark.end()
        return np.frombuffer(b"".join([*out, self._plain(text[at:])]), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the arcs, read as UTF-8."""
        return b"".join(map(self.labels.__getitem__, ids.tolist())).decode("utf-8", "replace")


def compile_merges(vocabulary: str, split: str) -> Automaton:
    """Read a byte-level vocabulary file (JSON) and compile its merges.

    Only files whose settings this module carries out are accepted: byte-level pre-splitting
    without an added space, no normaliser, no dropout, and special tokens taken as they stand.
    """
    with open(vocabulary, encoding="utf-8") as file:
        data = json.load(file)
    model, before = data["model"], data["pre_tokenizer"]
    added = data.get("added_tokens", [])
    if (
        data.get("normalizer")
        or before.get("type") != "ByteLevel"
        or before.get("add_prefix_space")
        or model.get("ignore_merges")
        or model.get("dropout")
        or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added)
    ):
        raise ValueError("this vocabulary asks for steps that are not carried out here")
    letters, ids = byte_letters(), model["vocab"]
    labels = [b""] * (1 + max([*ids.values(), *(x["id"] for x in added)]))
    for text, token in ids.items():
        labels[token] = bytes(letters[x] for x in text)
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
    special = {x["content"]: x["id"] for x in added}
    # The labels of special tokens are matched before the words are split, never inside them.
    automaton = Automaton(labels, merges, special, split)
    for text, token in special.items():
        automaton.labels[token] = text.encode()
    return automaton


def encode_documents(docs: DataFrame, automaton: Automaton, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole text and decode the ids: counts and digests, one row per input row.

    A null text is encoded as an empty one; a null id stays null; repeated rows each give a row.
    The automaton (a few MB, fixed by the vocabulary) is broadcast. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine, rows = shared.value, []
        for body in batch.column(1):
            ids = machine.encode(body.as_py() or "")
            decoded = machine.decode(ids).encode()
            rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        counts, coded, decoded = zip(*rows, strict=True)
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return map_batches(rows, work, OUT)
