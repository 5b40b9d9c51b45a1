"""Token counts that follow edits without encoding whole documents again.

A document keeps a segment tree. Its leaves are runs of pre-tokens with their characters and
tokens; inner nodes hold the sums. An edit finds its leaf by walking down the character sums, takes
leaves before it with at least ``CONTEXT`` pre-tokens as context, and pre-tokenizes from there until a pre-token starts where an
untouched leaf started: from then on the text, and so the pre-tokens, are the old ones. Only that
stretch is encoded, and only the sums above the touched leaves change. A leaf that has grown past
``LEAF_LIMIT`` pre-tokens is cut anew with its tree.

Pre-tokens are matched left to right and a match looks at most at the white space after it, so a
start two pre-tokens before the edit is safe.

* Null text is empty: one leaf of nothing. Null or empty edits change nothing.
* An edit is (at, remove, insert) in characters of the text that the edits before it left; ``at``
  and ``remove`` are clipped to the text, a null ``insert`` is empty.
* Documents are independent rows: repeated rows, ties and clashing names have no effect; input
  columns are kept unless an output has their name.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneframe.llm.registry import query, table

RANKS = "byte_bpe_50k.tiktoken"
LEAF = 64
LEAF_LIMIT = 4 * LEAF
CONTEXT = 3
CACHE = 200_000


class Encoder:
    """Tokens of a pre-token, from a rank file; counts are remembered up to a bound."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, pretoken: str) -> int:
        n = self.known.get(pretoken)
        if n is None:
            n = len(self.encoding.encode_ordinary(pretoken))
            if len(pretoken) < 64:
                if len(self.known) >= CACHE:
                    self.known.clear()
                self.known[pretoken] = n
        return n

    def leaves(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Characters, tokens and pre-tokens of the leaves of a text."""
        found = self.pattern.findall(text)
        chars = np.fromiter(map(len, found), np.int64, len(found))
        tokens = np.fromiter(map(self.count, found), np.int64, len(found))
        if not len(found):
            return [0], [0], [0]
        at = np.arange(0, len(found), LEAF)
        size = np.minimum(LEAF, len(found) - at)
        return np.add.reduceat(chars, at).tolist(), np.add.reduceat(tokens, at).tolist(), size.tolist()


class TokenTree:
    """Segment tree over leaves: sums of characters and tokens in two arrays, node i above 2i and 2i + 1."""

    def __init__(self, chars, tokens, sizes):
        self.n = len(chars)
        self.width = 1 << max(0, self.n - 1).bit_length()
        self.sizes = list(sizes)
        self.sums = [self._tree(chars), self._tree(tokens)]

    def _tree(self, values) -> list[int]:
        tree = [0] * self.width + list(values) + [0] * (self.width - self.n)
        for i in range(self.width - 1, 0, -1):
            tree[i] = tree[2 * i] + tree[2 * i + 1]
        return tree

    @property
    def chars(self) -> int:
        return self.sums[0][1]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def find(self, position: int) -> tuple[int, int]:
        """Leaf that holds the character at ``position``, and where the leaf starts."""
        node, start, tree = 1, 0, self.sums[0]
        while node < self.width:
            node *= 2
            if position >= start + tree[node] and start + tree[node] < self.chars:
                start += tree[node]
                node += 1
        return node - self.width, start

    def set(self, leaf: int, chars: int, tokens: int, size: int) -> None:
        self.sizes[leaf] = size
        for tree, value in zip(self.sums, (chars, tokens)):
            node = leaf + self.width
            change = value - tree[node]
            while node and change:
                tree[node] += change
                node //= 2

    def leaf_chars(self, leaf: int) -> int:
        return self.sums[0][leaf + self.width]

    def lists(self) -> tuple[list[int], list[int], list[int]]:
        return self.sums[0][self.width : self.width + self.n], self.sums[1][self.width : self.width + self.n], self.sizes


def edit(text: str, tree: TokenTree, at: int, remove: int, insert: str, encoder: Encoder) -> tuple[str, TokenTree, int]:
    """The edited text, its tree and how many characters were encoded for it."""
    at = min(max(0, at), len(text))
    remove = min(max(0, remove), len(text) - at)
    new = text[:at] + insert + text[at + remove :]
    shift = len(insert) - remove
    first, start = tree.find(max(0, at - 1))
    context = 0
    while first > 0 and context < CONTEXT:  # edited leaves may hold few pre-tokens or none
        first -= 1
        start -= tree.leaf_chars(first)
        context += tree.sizes[first]
    # Starts of the leaves beyond the edit, in the new text.
    end, last = start, first
    chars, found = 0, []
    for match in encoder.pattern.finditer(new, start):
        here = match.start()
        while last < tree.n and (end < at + remove or end + shift < here or last == first):
            end += tree.leaf_chars(last)
            last += 1
        if here == end + shift and end >= at + remove and last < tree.n:
            break
        piece = match.group()
        chars += len(piece)
        found.append((len(piece), encoder.count(piece)))
    else:
        last = tree.n
    if len(found) > LEAF_LIMIT:
        parts = [found[i : i + LEAF] for i in range(0, len(found), LEAF)]
        fresh = [sum(n for n, _ in p) for p in parts], [sum(n for _, n in p) for p in parts], [len(p) for p in parts]
        return new, TokenTree(*(old[:first] + values + old[last:] for old, values in zip(map(list, tree.lists()), fresh))), chars
    tree.set(first, chars, sum(n for _, n in found), len(found))
    for leaf in range(first + 1, last):
        tree.set(leaf, 0, 0, 0)
    return new, tree, chars


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder_for(path: str | None = None, pattern: str | None = None) -> Encoder:
    """One per worker process. Default: the byte-level vocabulary and its pre-token pattern."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


TREE = "leaf_chars array<long>, leaf_tokens array<long>, leaf_pretokens array<long>, n_tokens long"
EDITED = "text string, leaf_chars array<long>, leaf_tokens array<long>, leaf_pretokens array<long>, n_tokens long, encoded_chars long"


def count_tokens(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Input columns, the leaves of each text's tree, and n_tokens. Write it to keep the trees."""

    @F.pandas_udf(TREE)
    def build(texts: pd.Series) -> pd.DataFrame:
        encoder = encoder_for(path, pattern)
        rows = [encoder.leaves(text or "") for text in texts]
        return pd.DataFrame([(*row, sum(row[1])) for row in rows], columns=["leaf_chars", "leaf_tokens", "leaf_pretokens", "n_tokens"])

    keep = [c for c in docs.columns if c not in ("leaf_chars", "leaf_tokens", "leaf_pretokens", "n_tokens")]
    return docs.select(*keep, build(F.col("text")).alias("_t")).select(*keep, "_t.*")


def apply_edits(counted: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Apply the column ``edits`` (array of at, remove, insert) to text and tree.

    Returns the input columns with the new text, leaves and n_tokens, and encoded_chars: the characters
    that had to be encoded, all edits together. A null edit, or one without a place, changes nothing; a null ``remove`` is 0, a
    null ``insert`` nothing.
    """

    @F.pandas_udf(EDITED)
    def change(rows: pd.DataFrame) -> pd.DataFrame:
        encoder = encoder_for(path, pattern)
        out = []
        for text, edits, *leaves in zip(rows["text"], rows["edits"], rows["leaf_chars"], rows["leaf_tokens"], rows["leaf_pretokens"]):
            text, tree, encoded = text or "", TokenTree(*(list(map(int, x)) for x in leaves)), 0
            for e in edits if edits is not None else ():
                if e is None or e["at"] is None:
                    continue
                text, tree, n = edit(text, tree, int(e["at"]), int(e["remove"] or 0), e["insert"] or "", encoder)
                encoded += n
            out.append((text, *tree.lists(), tree.tokens, encoded))
        return pd.DataFrame(out, columns=["text", "leaf_chars", "leaf_tokens", "leaf_pretokens", "n_tokens", "encoded_chars"])

    changed = ["text", "leaf_chars", "leaf_tokens", "leaf_pretokens", "n_tokens", "encoded_chars"]
    keep = [c for c in counted.columns if c not in (*changed, "edits")]
    state = F.struct("text", "edits", "leaf_chars", "leaf_tokens", "leaf_pretokens")
    return counted.select(*keep, change(state).alias("_t")).select(*keep, "_t.*")


def sample_edits(docs: DataFrame) -> DataFrame:
    """Adds three edits to every document: a title before it, a stretch replaced at a place that its
    id fixes, and its middle character turned into a line end."""
    size = F.char_length(F.coalesce(F.col("text"), F.lit("")))
    place = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % (size + 1)

    def entry(at, remove, insert):
        return F.struct(at.cast("long").alias("at"), F.lit(remove).cast("long").alias("remove"), insert.alias("insert"))

    return docs.withColumn("edits", F.array(
        entry(F.lit(0), 0, F.concat(F.lit("Source "), F.coalesce(F.col("source"), F.lit("unknown")), F.lit("\n\n"))),
        entry(place, 24, F.lit(" one more 2026 edit's words ")), entry(F.floor(size / 2), 1, F.lit("\n"))))


@query("op10_token_edits")
def op10(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    counted = count_tokens(sample_edits(docs)).withColumn("tokens_before", F.col("n_tokens"))
    edited = apply_edits(counted)
    return edited.select(
        "doc_id", "tokens_before", F.col("n_tokens").alias("tokens_after"), F.size("leaf_tokens").alias("n_leaves"),
        F.char_length("text").cast("long").alias("n_chars_after"), "encoded_chars",
    )
