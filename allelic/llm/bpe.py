"""Byte-level BPE: a lazily determinised finite-state transducer and a streaming decoder.

Merging by rank gives the one segmentation of a byte string into vocabulary tokens in which
every token is its own encoding and every two neighbours encode to themselves. That makes the
merges a transducer: a hypothesis is (pending tokens, last token, node of the vocabulary trie),
a byte moves every hypothesis along the trie and lets it end a token that is compatible with
the last one. The set of hypotheses is the determinised state, built when first reached. Tokens
on which all hypotheses agree are emitted; a hypothesis dies once its trie path ends, so the
lookahead is bounded by the longest token.

Defined cases: a null text counts as empty and gives no tokens; repeated rows get equal
results; an empty table gives an empty table; input columns that bear the name of a result
column are replaced. Memos are cleared at fixed sizes, so memory does not grow with the input.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, types as T

from .common import field, map_text

ROOT = 0


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: merge the leftmost pair of lowest rank until none is in the vocabulary."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none, get = 1 << 60, ranks.get
    costs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while costs and (low := min(costs)) < none:
        at = costs.index(low)
        parts[at] += parts.pop(at + 1)
        del costs[at]
        if at < len(costs):
            costs[at] = get(parts[at] + parts[at + 1], none)
        if at:
            costs[at - 1] = get(parts[at - 1] + parts[at], none)
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes one piece (a match of the splitting pattern) at a time."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 120_000, max_pairs: int = 300_000):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.max_states, self.max_pairs = max_states, max_pairs
        self.next_node: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        nodes = 1
        for token, i in ranks.items():
            node = ROOT
            for byte in token:
                key = node << 8 | byte
                node = self.next_node.get(key) or self.next_node.setdefault(key, nodes)
                nodes += node == nodes
            self.ends[node] = i
        self.solid: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.hypotheses: list[tuple] = []
        self.moves: dict[int, tuple[int, tuple]] = {}
        self.flush: list[tuple] = []
        self.unheld = 0
        self.start = self._state((((), -1, ROOT),))

    def _state(self, hyps: tuple) -> int | None:
        """The number of a state; None for a new one once ``max_states`` are held."""
        found = self.states.get(hyps)
        if found is None:
            if len(self.hypotheses) >= self.max_states:
                self.unheld += 1
                return None
            found = self.states[hyps] = len(self.hypotheses)
            self.hypotheses.append(hyps)
            self.flush.append(self._rest(hyps))
        return found

    @staticmethod
    def _rest(hyps: tuple) -> tuple:
        """What is pending where the input ends: exactly one hypothesis stands between tokens."""
        return next(pend for pend, _, node in hyps if node == ROOT)

    def _own(self, token: int) -> bool:
        """Does the token encode to itself?"""
        if token not in self.solid:
            self.solid[token] = merge_by_rank(self.tokens[token], self.ranks) == [token]
        return self.solid[token]

    def _compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            found = self.pairs[a, b] = merge_by_rank(self.tokens[a] + self.tokens[b], self.ranks) == [a, b]
        return found

    def _advance(self, hyps_before: tuple, byte: int) -> tuple[tuple, tuple]:
        """The hypotheses after one more byte, and the tokens on which they agree."""
        hyps, next_node, ends, pairs = [], self.next_node.get, self.ends.get, self.pairs.get
        for pend, last, node in hyps_before:
            child = next_node(node << 8 | byte)
            if child is None:
                continue
            token = ends(child)
            if token is not None and self._own(token):
                fits = last < 0 or pairs((last, token))
                if fits is None:
                    fits = self._compatible(last, token)
                if fits:
                    hyps.append(((*pend, token), token, ROOT))
            hyps.append((pend, last, child))
        first = hyps[0][0]
        agreed = min([len(h[0]) for h in hyps])
        while agreed and any([h[0][:agreed] != first[:agreed] for h in hyps]):
            agreed -= 1
        if not agreed:
            return tuple(hyps), ()
        return tuple([(p[agreed:], last, node) for p, last, node in hyps]), first[:agreed]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if self.unheld > 50 * self.max_states:  # the input has drifted: learn its states anew
            self._reset()
        state, out, moves = self.start, [], self.moves
        for at, byte in enumerate(piece):
            key = state << 8 | byte
            step = moves.get(key)
            if step is None:
                hyps, emitted = self._advance(self.hypotheses[state], byte)
                target = self._state(hyps)
                if target is None:
                    return out + [*emitted, *self._walk(hyps, piece[at + 1 :])]
                step = moves[key] = (target, emitted)
            state, emitted = step
            if emitted:
                out += emitted
        out += self.flush[state]
        return out

    def _walk(self, hyps: tuple, rest: bytes) -> list[int]:
        """Goes on from a state that is not held."""
        out: list[int] = []
        for byte in rest:
            hyps, emitted = self._advance(hyps, byte)
            out += emitted
        out += self._rest(hyps)
        return out


class Utf8Stream:
    """Incremental UTF-8 state machine: gives the text of complete characters, holds the rest."""

    def __init__(self):
        self.held = b""

    def push(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                if need > back:
                    cut = len(data) - back
                break
            if byte < 0x80:
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class PieceMemo(dict):
    """Piece -> its ids in decimal, joined by commas.

    Two generations: once ``limit`` pieces are held, those not asked for since the last change
    are forgotten.
    """

    def __init__(self, transducer: Transducer, limit: int):
        self.transducer, self.limit, self.older = transducer, limit, {}

    def __missing__(self, piece: str) -> str:
        ids = self.older.get(piece)
        if ids is None:
            ids = ",".join(map(str, self.transducer.encode(piece.encode())))
            if len(piece) > 64:
                return ids
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, path: str, pattern: str, memo: int = 200_000):
        ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.memo = PieceMemo(Transducer(ranks), memo)
        self.bytes_of = {str(i): t for t, i in ranks.items()}

    def encode_joined(self, text: str | None) -> str:
        memo = self.memo
        return ",".join([memo[p] for p in self.split(text)]) if text else ""

    def encode(self, text: str | None) -> list[int]:
        joined = self.encode_joined(text)
        return list(map(int, joined.split(","))) if joined else []

    def decode_stream(self, ids: list[str], chunk: int = 8192):
        """Pieces of the decoded text; ``ids`` in decimal."""
        stream, of = Utf8Stream(), self.bytes_of.__getitem__
        for at in range(0, len(ids), chunk):
            yield stream.push(b"".join(map(of, ids[at : at + chunk])))
        yield stream.close()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec in each Python worker, whatever the number of its tasks."""
    return Codec(path, pattern)


FIELDS = [
    field("n_tokens", T.LongType()),
    field("ids_sha256", T.StringType()),
    field("decoded_sha256", T.StringType()),
]


def tokenize(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``tokens``: the ids of each whole text."""
    return map_text(
        docs,
        lambda: lambda texts: [[codec(path, pattern).encode(t) for t in texts]],
        [field("tokens", T.ArrayType(T.IntegerType()))],
        text_col,
    )


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens and the digests of the ids and of the text decoded from them."""

    def make():
        own = codec(path, pattern)

        def compute(texts):
            counts, ids_digests, digests = [], [], []
            for text in texts:
                joined = own.encode_joined(text)
                ids = joined.split(",") if joined else []
                counts.append(len(ids))
                ids_digests.append(hashlib.sha256(joined.encode()).hexdigest())
                digest = hashlib.sha256()
                for part in own.decode_stream(ids):
                    digest.update(part.encode())
                digests.append(digest.hexdigest())
            return [counts, ids_digests, digests]

        return compute

    return map_text(docs, make, FIELDS, text_col)
