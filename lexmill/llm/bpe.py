"""BPE encoding and decoding by a depth-first walk over the trie of distinct words.

The last token of a BPE encoding is a state: the encoding of a prefix ends in the one
token t whose own text is a suffix of the prefix and which stays apart from the last
token of what precedes it (the pair of both encodes to just that pair). So a trie node
needs only its last token and that token's length; words that share a prefix share the
states along it. Sorted words visit the trie depth first, and the states of the path to
the current node are the only ones held.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"
#: After every merge.
LAST = 1 << 60
#: Encoded words that a task remembers, at most (about 200 MB); beyond it starts anew.
REMEMBERED = 250_000
# The pattern of the public vocabulary file, with its white space spelled out.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\p{L}\p{N}]+"
)
#: Python splits at these, the pattern does not.
ODD_SPACES = regex.compile(r"[\x1c-\x1f]")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordTrie:
    """Encodes words over a vocabulary with end-of-word symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.vocab: dict[str, int] = model["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.rank = {(a, b): k for k, (a, b) in enumerate(merges)}
        self.specials = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.text_of = {i: t for t, i in [*self.vocab.items(), *self.specials.items()]}
        self.made = {a + b: (k, a, b) for (a, b), k in reversed(self.rank.items())}
        self.right = cache(lambda token: self._spine(token, True))
        self.left = cache(lambda token: self._spine(token, False))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.inner = self._by_ending(t for t in self.vocab if not t.endswith(END))
        self.final = self._by_ending(t for t in self.vocab if t.endswith(END))
        self.alphabet = byte_alphabet()
        self.latin = {b: c for b, c in self.alphabet.items() if chr(b) != c}
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None

    @staticmethod
    def _by_ending(tokens) -> dict:
        """A trie of the tokens read backwards; "" in a node is the token that ends its walk."""
        root: dict = {}
        for token in tokens:
            node = root
            for c in reversed(token.removesuffix(END)):
                node = node.setdefault(c, {})
            node[""] = token
        return root

    def _spine(self, token: str, right: bool) -> list[tuple[str, int]]:
        """Symbols at the right (or left) edge of a token while it is built, each with the rank of the merge that ends it."""
        made = self.made.get(token)
        if made is None:
            return [(token, LAST)]
        inner = self._spine(made[1 + right], right)
        return [*inner[:-1], (inner[-1][0], made[0]), (token, LAST)]

    def _apart(self, left: str, right: str) -> bool:
        """Whether the texts of both tokens, one after the other, encode to just these two.

        Merges go by rank, the leftmost first among equals, so it is enough to follow the
        symbols on both sides of the border and see whether one of their own merges always
        comes before a merge across it.
        """
        a, b, rank = self.right(left), self.left(right), self.rank
        i = j = 0
        while True:
            across, (_, end_a), (_, end_b) = rank.get((a[i][0], b[j][0]), LAST), a[i], b[j]
            if across < end_a and across <= end_b and across < LAST:
                return False
            if end_a <= end_b:
                if end_a == LAST:
                    return True
                i += 1
            else:
                j += 1

    def encode_words(self, words) -> dict[str, list[str]]:
        """Tokens of each distinct word (spelled in the byte alphabet), walking the trie depth first."""
        out, before = {}, ""
        path = [""]  # path[d]: the last token of the current prefix of length d
        apart, known, inner, final = self._apart, self.pairs, self.inner, self.final
        for word in sorted(set(words)):
            n, depth = len(word), 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                depth += 1
            del path[depth + 1 :]
            for depth in range(len(path), n + 2):
                # Tokens that end here, the shortest first; one of them fits what comes before.
                node, k, ending = (inner, depth - 1, []) if depth <= n else (final, n - 1, [])
                while k >= 0:
                    node = node.get(word[k])
                    if node is None:
                        break
                    token = node.get("")
                    if token is not None:
                        ending.append((path[k], token))
                    k -= 1
                for pair in reversed(ending):
                    fits = known.get(pair)
                    if fits is None:
                        fits = known[pair] = not pair[0] or apart(*pair)
                    if fits:
                        break
                else:
                    raise ValueError(f"no token of the vocabulary ends {word[:depth]!r}")
                path.append(pair[1])
            tokens = [path.pop()]
            at = n - len(tokens[0]) + len(END)
            while at:
                tokens.append(path[at])
                at -= len(path[at])
            tokens.reverse()
            out[word] = tokens
            before = word
        if len(known) > 4 * REMEMBERED:
            known.clear()
        return out

    def pieces(self, text: str) -> list[str]:
        """Words of a text, normalised and spelled in the byte alphabet."""
        if text.isascii():
            text = text.lower()
            return [text] if text.isalpha() else [p.translate(self.alphabet) for p in PIECES.findall(text)]
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [p.encode().decode("latin-1").translate(self.latin) for p in PIECES.findall(text)]


class Encoder:
    """Texts to (token count, ids joined by a space, token texts joined by a space)."""

    def __init__(self, path: str):
        self.trie = WordTrie(path)
        self.known: dict[str, tuple[int, str, str]] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        spelled = {w: self.trie.pieces(w) for w in words}
        tokens = self.trie.encode_words(p for ps in spelled.values() for p in ps)
        for word, ps in spelled.items():
            own = [t for p in ps for t in tokens[p]]
            self.known[word] = (len(own), " ".join(str(self.trie.vocab[t]) for t in own), " ".join(own))

    def _words(self, text: str) -> list[str]:
        """Parts of a text that encode independently: white-space words, and special tokens."""
        specials, odd = self.trie.special_pattern, ODD_SPACES.search(text)
        if not (odd or specials and specials.search(text)):
            return text.split()
        out, at = [], 0
        for m in [*specials.finditer(text), None] if specials else [None]:
            part = text[at : m.start()] if m else text[at:]
            out += [part] if odd else part.split()
            if m:
                out.append(m[0])
                at = m.end()
        return out

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        for token, i in self.trie.specials.items():
            self.known[token] = (1, str(i), token)
        split = [self._words(t or "") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
            return self.encode(texts)
        if new := set().union(*split) - self.known.keys():
            self._learn(new)
        out, known = [], self.known
        for words in split:
            found = [x for x in map(known.__getitem__, words) if x[0]]
            out.append((sum(x[0] for x in found), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])))
        return out


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_table(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    `vocabulary` is a tokenizers JSON file that exists on every executor. Returns doc_id,
    n_tokens, ids_sha256 and decoded_sha256 (and ids and decoded with keep_ids), one row
    per input row: repeated rows repeat, null and empty texts have no tokens, a null id
    stays null, an empty table gives an empty result. Each task walks the trie of the
    words new to it and remembers a bounded number of encodings, so memory does not
    depend on the size of the table.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    names = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema = schema.append(pa.field("ids", pa.list_(pa.int32()))).append(pa.field("decoded", pa.string()))
        names += ", ids array<int>, decoded string"

    def run(batches):
        gc.disable()  # millions of small tuples and no cycles: scanning them again and again finds nothing
        encoder = _encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                done = encoder.encode(part.column(1).to_pylist())
                digest = [[hashlib.sha256(x[k].encode()).hexdigest() for x in done] for k in (1, 2)]
                columns = [part.column(0), pa.array([x[0] for x in done], pa.int64()), pa.array(digest[0]), pa.array(digest[1])]
                if keep_ids:
                    columns += [pa.array([[int(i) for i in x[1].split()] for x in done], pa.list_(pa.int32())), pa.array([x[2] for x in done])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, names)
