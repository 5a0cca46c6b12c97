"""Operator 3, BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is exactly one last token that its encoding can end with.
It is found from left to right: an automaton over the vocabulary (all tokens that are a suffix
of the prefix, with failure links) gives the candidates, and a candidate is the one if it can
follow the last token of the prefix before it. Whether two tokens may stand next to each other
is read off the merge tree once a pair. Back-pointers then give the ids. No merge loop runs, so
a word of any length takes time in proportion to its length.

Texts are cut into the tokenizer's words; each distinct piece between spaces is encoded once a
worker (bounded table). The new words of a block of texts go through the automaton as one string
and are advanced together, one prefix length a step. Decoding joins the tokens' bytes and reads them as UTF-8.

Defined results: a null text is an empty one (no ids); repeated rows, null ids and equal texts
give rows of their own; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, small

#: Fixed: white space as the tokenizer's patterns see it.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed: the pattern of byte-level BPE.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Before a space that follows something else a word always ends.
_SEAM = re.compile(rf"(?<=[^{SPACE}])(?= )")
_RUN = re.compile(rf"[{SPACE}] ")
FOREVER = 1 << 60
#: Letters up to here are alike for every version of Unicode; beyond, the tokenizer's own pattern cuts words.
SETTLED = "\u024f"
#: Bits of a token id, of the table of known pairs; bytes of text encoded together; longest word advanced with others.
ID, SLOTS, BLOCK, LONG = 17, 20, 1 << 22, 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or 256 and up in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE model read from a tokenizers file."""

    def __init__(self, path: str, pieces: int = 800_000):
        import os

        import ahocorasick
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.special_bytes = {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
        self.token = {i: as_bytes(s) for s, i in vocab.items() if s not in self.special} | {i: s.encode() for s, i in self.special.items()}
        ids = {as_bytes(s): i for s, i in vocab.items() if s not in self.special}
        self.single = [ids[bytes([b])] for b in range(256)]
        # merge tree: the rank of a pair, and the halves and rank of the token it makes
        self.rank, self.halves, self.made = {}, {}, {}
        for k, merge in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            pair, whole = (ids[a], ids[b]), ids[a + b]
            self.rank.setdefault(pair, k)
            if whole not in self.halves:
                self.halves[whole], self.made[whole] = pair, k
        self.automaton = ahocorasick.Automaton()
        for s, i in ids.items():
            if len(s) == 1 or i in self.halves:
                self.automaton.add_word(s.decode("latin-1"), len(s) << ID | i)
        self.automaton.make_automaton()
        self.find = regex.compile(WORDS).findall
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.alphabet = alphabet
        self.pieces, self.most = {}, pieces
        self.pair, self.fits = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, bool)
        self.edges: tuple[dict, dict] = {}, {}
        top = max(self.token) + 1
        self.length = np.array([len(self.token.get(i, b"")) for i in range(top)], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.flat = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(top)), np.uint8)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one end of a token while it is built, each with the rank at which a merge takes it in."""
        out = self.edges[side].get(token)
        if out is None:
            out, until, at = [], FOREVER, token
            while True:
                out.append((at, until))
                if at not in self.halves:
                    break
                until, at = self.made[at], self.halves[at][side]
            self.edges[side][token] = out
        return out

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge would ever reach across the seam of two neighbouring tokens.

        A pair at the seam is merged if its rank comes before that of the merge that takes the
        left one in; of equal merges the leftmost goes first, so it must not come after that of the right one.
        """
        rank, starts = self.rank, self._edge(right, 0)
        for a, until_a in self._edge(left, 1):
            for b, until_b in starts:
                r = rank.get((a, b))
                if r is not None and r < until_a and r <= until_b:
                    return False
        return True

    def _may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """may_follow for arrays, by a table of pairs in which a new pair takes an old one's slot."""
        key = left << ID | right
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = self.fits[slot]
        new = np.flatnonzero(self.pair[slot] != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            fits = np.array([self.may_follow(k >> ID, k & ((1 << ID) - 1)) for k in keys.tolist()])
            out[new] = fits[back]
            self.pair[slot[new]] = key[new]
            self.fits[slot[new]] = out[new]
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """ids of one word: `last` holds, for every prefix, the one token it can end with."""
        n = len(word)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for end, match in self.automaton.iter(word.decode("latin-1")):
            at, token = end + 1 - (match >> ID), match & ((1 << ID) - 1)
            if last[end + 1] < 0 and (not at or self.may_follow(last[at], token)):
                last[end + 1], back[end + 1] = token, at
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """encode_word of many words, as uint32 bytes; all words advance by one prefix length a step."""
        size = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(size + 1) - size - 1  # a character that no token has follows each word
        joined = "\u0100".join(w.decode("latin-1") for w in words)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        word = np.searchsorted(first, found[:, 0], "right") - 1
        length, token = found[:, 1] >> ID, found[:, 1] & ((1 << ID) - 1)
        end = found[:, 0] + 1 - first[word]
        order = np.argsort(end, kind="stable")
        word, token, at, goal = word[order], token[order], (first[word] + end - length)[order], (first[word] + end)[order]
        last, back = np.zeros(len(joined) + 1, np.int64), np.zeros(len(joined) + 1, np.int64)
        begins = at == first[word]
        steps = np.searchsorted(end[order], np.arange(1, int(size.max()) + 2))
        for lo, hi in pairwise(steps.tolist()):
            ok = begins[lo:hi].copy()
            rest = np.flatnonzero(~ok) + lo
            # a prefix has one last token only, so any candidate that fits is it
            ok[rest - lo] = self._may_follow(last[at[rest]], token[rest])
            own = np.flatnonzero(ok) + lo
            last[goal[own]], back[goal[own]] = token[own], at[own]
        # back-pointers of all words together, from their ends
        here, whose, out_word, out_token = first + size, np.arange(len(words)), [], []
        while len(here):
            out_word.append(whose)
            out_token.append(last[here])
            here = back[here]
            more = here > first[whose]
            here, whose = here[more], whose[more]
        owner, ids = np.concatenate(out_word)[::-1], np.concatenate(out_token)[::-1]
        order = np.argsort(owner, kind="stable")
        flat, ends = ids[order].astype("<u4").tobytes(), np.cumsum(np.bincount(owner, minlength=len(words))) * 4
        return [flat[a:b] for a, b in pairwise([0, *ends.tolist()])]

    def _words(self, piece: str) -> list[str]:
        if piece[0] == " " and piece[1:].isalpha() and max(piece) <= SETTLED:
            return [piece]
        if max(piece) <= SETTLED:
            return self.find(piece)
        return [bytes(self.alphabet[c] for c in x).decode() for x, _ in self.split(piece)]

    def _learn(self, pieces: set[str]) -> None:
        """Adds the ids of all pieces to the table."""
        known = self.pieces
        missing = pieces.difference(known)
        if len(known) + 2 * len(missing) > self.most:
            known.clear()
            missing = pieces
        cut = {x: self._words(x) for x in missing}
        words = list({w for ws in cut.values() for w in ws}.difference(known))
        coded = [w.encode() for w in words]
        short = [k for k, w in enumerate(coded) if len(w) <= LONG]
        for k in range(0, len(short), 20_000):
            some = short[k : k + 20_000]
            known.update(zip([words[i] for i in some], self.encode_words([coded[i] for i in some]), strict=True))
        for w, c in zip(words, coded, strict=True):
            if len(c) > LONG:
                known[w] = np.array(self.encode_word(c), "<u4").tobytes()
        for x, ws in cut.items():
            if len(ws) != 1:
                known[x] = b"".join([known[w] for w in ws])

    def _pieces(self, text: str) -> list[str]:
        """Parts of a text between which a word always ends."""
        if not text:
            return []
        if _RUN.search(text):
            return _SEAM.split(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """ids (uint32) of each text; a special token's string in a text gives its id."""
        block: list[list[list[str]]] = []
        size = 0

        def done():
            self._learn({x for parts in block for part in parts for x in part if x not in self.special})
            get = (self.pieces | self.special_bytes).__getitem__ if any(len(p) > 1 for p in block) else self.pieces.__getitem__
            for parts in block:
                yield np.frombuffer(b"".join([b"".join(map(get, part)) for part in parts]), "<u4")
            block.clear()

        for text in texts:
            if any(s in text for s in self.special):
                block.append([[x] if x in self.special else self._pieces(x) for x in self.special_pattern.split(text)])
            else:
                block.append([self._pieces(text)])
            size += len(text)
            if size > BLOCK:
                yield from done()
                size = 0
        yield from done()

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_batch([text]))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        length = self.length[ids]
        end = np.cumsum(length)
        return self.flat[np.arange(end[-1]) + np.repeat(self.start[ids] - end + length, length)].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


_MODELS: dict[str, ByteBpe] = {}


def model_of(path: str) -> ByteBpe:
    """The process's model of a tokenizer file: a Python worker keeps what it has learnt over its tasks, up to the table's bound."""
    if path not in _MODELS:
        _MODELS[path] = ByteBpe(path)
    return _MODELS[path]


def encode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds the ids (binary, uint32) and the decoded text."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields += [("ids", pa.binary()), ("decoded", pa.string())]
        out += ", ids binary, decoded string"
    schema = pa.schema(fields)

    def run(batches):
        model = model_of(tokenizer)
        decimal = [str(i) for i in range(len(model.length))]
        for b in small(batches):
            rows = []
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            for doc, ids in zip(b.column(0), model.encode_batch(texts), strict=True):
                joined = ",".join(map(decimal.__getitem__, ids.tolist()))
                decoded = model.decode_bytes(ids).decode("utf-8", "replace").encode()
                row = (doc.as_py(), len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                rows.append(row + ((ids.tobytes(), decoded.decode()) if with_ids else ()))
            yield batch({f.name: [r[k] for r in rows] for k, f in enumerate(schema)}, schema)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, out)
