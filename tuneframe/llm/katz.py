"""Katz backoff scores of texts: bigrams over unigrams over one unknown word.

Counts are Good-Turing discounted up to ``CUT`` occurrences. A context keeps for unseen followers the
mass its discounts freed, spread by the unigram model over exactly the words that it was never
followed by, so every context's probabilities sum to one over the vocabulary and the unknown
word. A context that freed nothing counts one more occurrence. The unigram level does the same
towards the unknown word.

1. Unigram counts, a table by word; words of a task are summed before the shuffle.
2. Every token goes to the partition of its context with its word and its place, packed in arrays
   per chunk of documents and partition. Words are named by rank among the most frequent ones, whose counts
   tasks are sent (at most ``TOP`` words, whatever the corpus); the others' counts come by a
   join with the unigram table. A context too frequent for one partition is dealt over several by
   its followers; its sums are added up afterwards. A bigram of such a context that has ``OFTEN`` tokens
   or more in a chunk goes there as one entry with its training count, and its value comes back to the
   chunk, which knows its documents: a group gets fewer than ``OFTEN`` tokens of a bigram from a chunk.
3. Each partition holds the whole bigram table of its contexts. It is read twice: for the counts of
   counts of all bigrams, and for the score, backing off token by token.

* Null text is empty: the end token alone, in the context of a start. No training document: nothing
  is known, every token has probability one (score and base of 0).
* Repeated rows are scored alike, each in its row. Very long texts are taken whole. Other columns are
  not looked at.
* Words and contexts are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuneframe.llm.registry import query, table
from tuneframe.llm.text import U64, distinct_words, laid_out, mix, word_hashes
from tuneframe.session import swept, written

CUT = 5
TOP = 1 << 19
PART_TOKENS = 1 << 18
CHUNK_DOCS = 1 << 14
CHUNK_BYTES = 4 << 20
OFTEN = 32
# Names of words: 0, 1, ... for frequent ones, negative for all others, the end and the start.
START, END = np.int64(-1), np.int64(-2)


def _named(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of the tokens of a column, text by text, each text's last the end; where each text begins, with one end more;
    and the name of each number: a word's hash as a negative number that is neither the end nor the start."""
    words, number, begin = distinct_words(pc.ascii_lower(texts))
    hashes = word_hashes(laid_out(words)[0])
    names = np.minimum(hashes | U64(1 << 63), U64(2**64 - 3)).view(np.int64)
    return np.insert(number.astype(np.int64), begin[1:], len(names)), begin + np.arange(len(begin)), np.append(names, END)


def _chunks(batches):
    """Slices of bounded size."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist()
        start, size = 0, 0
        for i, n in enumerate(sizes):
            size += n
            if size >= CHUNK_BYTES or i + 1 - start == CHUNK_DOCS or i + 1 == len(sizes):
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0


def unigrams(docs: DataFrame) -> DataFrame:
    """(word, n) over the documents where ``held_out`` is false; written."""

    def count(batches):
        for batch in _chunks(batches):
            tokens, _, names = _named(batch.column(0).filter(pc.invert(pc.fill_null(batch.column(1), False))))
            n = np.bincount(tokens, minlength=len(names))
            seen = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(names[seen]), pa.array(n[seen].astype(np.int64))], ["word", "n"])

    rows = docs.select("text", "held_out").mapInArrow(count, "word long, n long")
    return written(rows.groupBy("word").agg(F.sum("n").alias("n")), "katz-unigrams")


def discounts(n_of: dict[int, int]) -> np.ndarray:
    """Katz discount of each count: index 1..CUT, 1 above. A count whose Good-Turing estimate is not
    between 0 and 1 (too few counts of counts) is discounted by half an occurrence in r + 1."""
    n = np.array([n_of.get(r, 0) for r in range(CUT + 2)], float)
    d = np.ones(CUT + 2)
    cut = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        good = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        katz = (good - cut) / (1 - cut) if cut < 1 else 0.0
        d[r] = katz if 0 < katz < 1 else 1 - 0.5 / (r + 1)
    return d


class Unigrams:
    """Totals, discounts and the most frequent words of the unigram table."""

    def __init__(self, table_: DataFrame, top: int):
        sizes = table_.groupBy("n").agg(F.count(F.lit(1)).alias("types"))
        by_count = written(sizes, "katz-counts")
        n_of = {r["n"]: r["types"] for r in by_count.filter(F.col("n") <= CUT + 1).collect()}
        whole = by_count.agg(F.sum("types").alias("v"), F.sum(F.col("n") * F.col("types")).alias("n")).first()
        self.types, self.tokens = int(whole["v"] or 0), int(whole["n"] or 0)
        # Lowest count such that at most ``top`` words have it or more, from a row per distinct count.
        rising = by_count.withColumn("above", F.sum("types").over(Window.orderBy(F.desc("n"))))
        self.least = int(rising.filter(F.col("above") <= top).agg(F.min("n")).first()[0] or 2**62)
        frequent = table_.filter(F.col("n") >= self.least).toArrow()
        words, counts = frequent.column("word").to_numpy(), frequent.column("n").to_numpy()
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.discount = discounts(n_of)
        used = sum(n_of.get(r, 0) * r * (1 - self.discount[r]) for r in range(1, CUT + 1))
        self.total = self.tokens if used > 0 else self.tokens + 1
        self.unknown = (used if used > 0 else 1.0) / max(1, self.total)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """P of words by count; the unknown word for 0."""
        d = self.discount[np.minimum(counts, CUT + 1)]
        return np.where(counts > 0, d * counts / max(1, self.total), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


ROWS = "part long, chunk long, kind int, a binary, b binary, c binary, d binary"
_NAMES = [f.split()[0] for f in ROWS.split(", ")]
TOKENS, DOCUMENTS, OFTEN_SEEN = 0, 1, 2


def _row(part, chunk, kind, *arrays):
    blobs = [x.tobytes() if x is not None else None for x in (*arrays, *[None] * (4 - len(arrays)))]
    return (part, chunk, kind, *blobs)


def _batch(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)


_KINDS = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]


def _dealt(context: np.ndarray, word: np.ndarray, size: np.ndarray, parts: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition of each token, and whether its context is dealt over several."""
    ways = np.maximum(1, -(-size // bound)).astype(U64)
    way = mix(word.view(U64) ^ U64(0xA5A5)) % ways
    return (mix(mix(context.view(U64)) + way) % U64(parts)).astype(np.int64), ways > 1


def _tokens_of(texts: pa.Array, uni: Unigrams, n_start: int, parts: int, bound: int, near: bool):
    """Tokens of a chunk whose words are (``near``) or are not among the frequent ones: document, context, word, partition, whether the
    context is dealt over several, base score. And the sizes of all documents."""
    tokens, begin, names = _named(texts)
    sizes = np.diff(begin)
    # Words are looked up once each.
    at = np.minimum(np.searchsorted(uni.words, names), max(0, len(uni.words) - 1))
    known = uni.words[at] == names if len(uni.words) else np.zeros(len(names), bool)
    name = np.where(known, at, names)
    count = np.where(known, uni.counts[at], 0) if len(uni.words) else np.zeros(len(names), np.int64)
    own = np.flatnonzero(known[tokens] == near)
    before = tokens[own - 1]
    context, size = name[before], np.maximum(count, 1)[before]
    doc = np.repeat(np.arange(len(sizes)), sizes)[own]
    first = own == begin[doc]
    context[first], size[first] = START, n_start
    word = name[tokens[own]]
    part, hot = _dealt(context, word, size, parts, bound)
    return doc, context, word, part, hot, uni.base(count)[tokens[own]], sizes


def score(docs: DataFrame, top: int = TOP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of (doc_id, text, held_out).

    The model learns from the rows where ``held_out`` is false.
    """
    docs = docs.select("text", "held_out", "doc_id")
    table_ = unigrams(docs)
    uni = Unigrams(table_, top)
    n_start = int(docs.filter(~F.col("held_out")).count())
    everything = docs.select("held_out").count()
    share = max(1.0, everything / max(1, n_start))
    bound = PART_TOKENS
    parts = max(1, int(share * uni.tokens) // bound + 1)

    def deal(batches):
        partition = TaskContext.get().partitionId()
        for number, batch in enumerate(_chunks(batches)):
            chunk = (partition << 32) + number
            held = np.array(batch.column(1).to_pylist(), bool)
            doc, context, word, part, hot, base, sizes = _tokens_of(batch.column(0), uni, n_start, parts, bound, True)
            n = len(sizes)
            sums = np.stack((np.bincount(doc, base, n), np.bincount(doc, minlength=n)))
            at = np.flatnonzero(hot)
            at = at[np.lexsort((word[at], context[at], part[at]))]
            new = np.ones(len(at), bool)
            new[1:] = (word[at][1:] != word[at][:-1]) | (context[at][1:] != context[at][:-1])
            entry = np.cumsum(new) - 1
            often = np.bincount(entry) >= OFTEN if len(at) else np.zeros(0, bool)
            at, entry, first = at[often[entry]], (np.cumsum(often) - 1)[entry][often[entry]], at[new][often]
            # Which documents hold which entry, how often; entries are numbered by partition, context and word.
            own, times = np.unique(entry * n + doc[at], return_counts=True)
            held_by = np.stack((own // n, own % n, times)).astype(np.uint32)
            rows = [_row(-1 - chunk, chunk, DOCUMENTS, sizes.astype(np.int64), held, sums, held_by)]
            trained = np.bincount(entry, ~held[doc[at]], len(first)).astype(np.uint32)
            for i in np.split(np.arange(len(first)), np.flatnonzero(np.diff(part[first])) + 1) if len(first) else []:
                rows.append(_row(int(part[first[i[0]]]), chunk, OFTEN_SEEN, context[first[i]], i.astype(np.uint32), word[first[i]].astype(np.uint32), trained[i]))
            single = np.ones(len(doc), bool)
            single[at] = False
            at = np.flatnonzero(single)
            at = at[np.lexsort((context[at], part[at]))]
            cuts = np.flatnonzero(np.diff(part[at])) + 1
            for own in np.split(at, cuts) if len(at) else []:
                v, size = np.unique(context[own], return_counts=True)
                tag = doc[own] * 2 + held[doc[own]]
                rows.append(_row(int(part[own[0]]), chunk, TOKENS, v, size.astype(np.uint32), word[own].astype(np.uint32), tag.astype(np.uint16)))
            yield _batch(rows, _NAMES, _KINDS)

    def rare(batches):
        partition = TaskContext.get().partitionId()
        for number, batch in enumerate(_chunks(batches)):
            held = np.array(batch.column(1).to_pylist(), bool)
            doc, context, word, part, *_ = _tokens_of(batch.column(0), uni, n_start, parts, bound, False)
            columns = [part, np.full(len(doc), (partition << 32) + number), doc * 2 + held[doc], context, word]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "chunk", "tag", "context", "word"])

    dealt = docs.mapInArrow(deal, ROWS)
    others = docs.mapInArrow(rare, "part long, chunk long, tag long, context long, word long")
    counts = table_.filter(F.col("n") < uni.least)
    others = others.join(counts, "word", "left").select("part", "chunk", "tag", "context", "word", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    others = written(others, "katz-rare")
    swept(docs.sparkSession)

    def gather(own, few):
        """Tokens of a partition as arrays: chunk, tag, context, word, count of the word, training count, number of the
        entry (-1: a single token)."""
        kinds = np.array(own.column("kind").to_pylist(), np.int64)
        at = np.flatnonzero(kinds == TOKENS)
        often = own.take(pa.array(np.flatnonzero(kinds == OFTEN_SEEN)))
        v2, entry, w2, trained = (np.concatenate([*[np.frombuffer(x, k) for x in often.column(c).to_pylist()], np.zeros(0, k)]).astype(np.int64)
                                  for c, k in zip("abcd", (np.int64, np.uint32, np.uint32, np.uint32)))
        c2 = np.repeat(often.column("chunk").to_numpy(), [len(x) // 8 for x in often.column("a").to_pylist()]).astype(np.int64)
        blobs = [own.column(c).take(pa.array(at)).to_pylist() for c in "abcd"]
        chunks = own.column("chunk").to_numpy()[at]
        v = [np.repeat(np.frombuffer(a, np.int64), np.frombuffer(b, np.uint32)) for a, b in zip(*blobs[:2])]
        w = [np.frombuffer(c, np.uint32) for c in blobs[2]]
        word = np.concatenate([*w, np.zeros(0, np.uint32)]).astype(np.int64)
        seen = uni.counts[word] if len(word) else word
        chunk = np.concatenate((np.repeat(chunks, [len(x) for x in w]).astype(np.int64), few.column("chunk").to_numpy()))
        tag = np.concatenate([*[np.frombuffer(d, np.uint16) for d in blobs[3]], few.column("tag").to_numpy()]).astype(np.int64)
        context = np.concatenate([*v, few.column("context").to_numpy()]).astype(np.int64)
        word, seen = np.concatenate((word, few.column("word").to_numpy())), np.concatenate((seen, few.column("n").to_numpy()))
        n, single = 1 - (tag & 1), np.full(len(tag), -1)
        seen2 = uni.counts[w2] if len(w2) else w2
        return [np.concatenate(x) for x in ((chunk, c2), (tag, np.zeros_like(c2)), (context, v2), (word, w2), (seen, seen2), (n, trained), (single, entry))]

    def table_of(n, context, word):
        """Tokens sorted by bigram: order, first token of each bigram, training count of each, bigram of each token."""
        order = np.lexsort((word, context))
        v, w = context[order], word[order]
        new = np.ones(len(order), bool)
        new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
        bigram = np.cumsum(new) - 1
        r = np.bincount(bigram, n[order], minlength=int(new.sum())).astype(np.int64)
        return order, np.flatnonzero(new), r, bigram

    def count_bigrams(key, own, few):
        if not 0 <= key[0].as_py() < parts:
            return pa.table({"r": pa.array([], pa.int64()), "types": pa.array([], pa.int64())})
        _, _, context, word, _, n, _ = gather(own, few)
        r = table_of(n, context, word)[2] if len(n) else np.zeros(0, np.int64)
        types = np.bincount(r[(r > 0) & (r <= CUT + 1)], minlength=CUT + 2)[1:]
        return pa.table({"r": pa.array(range(1, CUT + 2), pa.int64()), "types": pa.array(types.astype(np.int64))})

    counted = dealt.groupBy("part").cogroup(others.groupBy("part")).applyInArrow(count_bigrams, "r long, types long")
    # Counts of counts go to every partition as rows of its smaller side, so that both readings share one shuffle.
    of_counts = counted.groupBy("r").agg(F.sum("types").alias("n"))
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
    zero = F.lit(0).cast("long")
    of_counts = of_counts.select(everywhere, F.lit(-1).cast("long").alias("chunk"), F.col("r").alias("tag"), zero.alias("context"), zero.alias("word"), "n")
    informed = others.unionByName(of_counts)

    # kind 0: a chunk's documents as dealt; 1: sums of its documents; 2: tokens of a dealt context; 3: sums of that context;
    # 4: entries of a dealt context
    out_rows = "kind int, chunk long, context long, a binary, b binary, c binary, d binary"
    names = [f.split()[0] for f in out_rows.split(", ")]
    out_kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]

    def judge(key, own, few):
        if key[0].as_py() < 0:
            rows = [(0, c, None, *x) for c, *x in zip(*(own.column(x).to_pylist() for x in ("chunk", "a", "b", "c", "d")))]
            return pa.Table.from_batches([_batch(rows, names, out_kinds)])
        told = few.column("chunk").to_numpy() < 0
        n_of = dict(zip(few.column("tag").to_numpy()[told].tolist(), few.column("n").to_numpy()[told].tolist()))
        tokens = gather(own, few.filter(pa.array(~told)))
        rows = _judged(*tokens, discounts(n_of)) if len(tokens[0]) else []
        return pa.Table.from_batches([_batch(rows, names, out_kinds)])

    def _judged(chunk, tag, context, word, seen, n, entry, discount):
        order, first, r, bigram = table_of(n, context, word)
        v = context[order][first]
        p1 = uni.probability(seen[order][first])
        mass = discount[np.minimum(r, CUT + 1)] * r
        new = np.concatenate((np.ones(1, bool), v[1:] != v[:-1]))
        group = np.cumsum(new) - 1
        names_ = v[new]
        total = np.bincount(group, r)
        spent = np.bincount(group, mass)
        covered = np.bincount(group, np.where(r > 0, p1, 0.0))
        size = np.where(names_ == START, n_start, 0)
        rank = (names_ >= 0) & (len(uni.counts) > 0)
        size[rank] = uni.counts[names_[rank]]
        hot = -(-size // bound) > 1
        whole, alpha = _backoff(total, spent, covered)
        with np.errstate(divide="ignore"):
            local = np.where(r > 0, np.log10(np.maximum(mass, 1e-300)), np.log10(p1))
            shift = np.where(hot[group], 0.0, np.where(r > 0, -np.log10(np.maximum(whole, 1))[group], np.log10(alpha)[group]))
        part = (local + shift)[bigram]
        chunk, tag, far, entry = chunk[order], tag[order] >> 1, seen[order], entry[order]
        lone = word[order] < 0
        base, known = np.where(lone, uni.base(far), 0.0), (lone & (far > 0)).astype(float)
        rows = []
        single = np.flatnonzero(entry < 0)
        single = single[np.argsort(chunk[single], kind="stable")]
        for own in np.split(single, np.flatnonzero(np.diff(chunk[single])) + 1) if len(single) else []:
            c = int(chunk[own[0]])
            docs_, at = np.unique(tag[own], return_inverse=True)
            rare = own[lone[own]]  # the chunk knows the counts of all other words itself
            far_docs, far_at = np.unique(tag[rare], return_inverse=True)
            far_sums = np.stack([np.bincount(far_at, x[rare]) for x in (base, known)]) if len(rare) else None
            rows.append((1, c, None, docs_.astype(np.uint16).tobytes(), np.bincount(at, part[own]).tobytes(),
                         far_docs.astype(np.uint16).tobytes() if len(rare) else None, far_sums.tobytes() if len(rare) else None))
        hot_token = hot[group][bigram]
        if hot_token.any():
            at = np.flatnonzero(hot_token & (entry < 0))
            owner, unseen = names_[group][bigram][at], (r == 0)[bigram][at]
            pair = np.lexsort((chunk[at], owner))
            at, owner, unseen = at[pair], owner[pair], unseen[pair]
            cut = np.flatnonzero((np.diff(owner) != 0) | (np.diff(chunk[at]) != 0)) + 1
            for i in np.split(np.arange(len(at)), cut) if len(at) else []:
                docs_, back = np.unique(tag[at[i]], return_inverse=True)
                both = np.stack((np.bincount(back, ~unseen[i]), np.bincount(back, unseen[i])))
                rows.append((2, int(chunk[at[i[0]]]), int(owner[i[0]]), docs_.astype(np.uint16).tobytes(), both.tobytes(), None, None))
            at = np.flatnonzero(entry >= 0)
            at = at[np.lexsort((chunk[at], group[bigram[at]]))]
            cut = np.flatnonzero((np.diff(group[bigram[at]]) != 0) | (np.diff(chunk[at]) != 0)) + 1
            for i in np.split(at, cut) if len(at) else []:
                rows.append((4, int(chunk[i[0]]), int(names_[group[bigram[i[0]]]]), entry[i].astype(np.uint32).tobytes(), part[i].tobytes(), (r[bigram[i]] == 0).tobytes(), None))
            for g in np.flatnonzero(hot).tolist():
                rows.append((3, None, int(names_[g]), np.array([total[g], spent[g], covered[g]]).tobytes(), None, None, None))
        return rows

    judged = dealt.groupBy("part").cogroup(informed.groupBy("part")).applyInArrow(judge, out_rows)
    judged = written(judged, "katz-parts")
    swept(docs.sparkSession)

    def sums(batches):
        for batch in batches:
            values = np.array([np.frombuffer(x, np.float64) for x in batch.column(1).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(values[:, i]) for i in range(3))], ["context", "total", "spent", "covered"])

    dealt_contexts = judged.filter("kind = 3").select("context", "a").mapInArrow(sums, "context long, total double, spent double, covered double")
    dealt_contexts = dealt_contexts.groupBy("context").agg(*(F.sum(c).alias(c) for c in ("total", "spent", "covered")))
    pending = judged.filter("kind IN (2, 4)").select("kind", "chunk", "context", "a", "b", "c").join(dealt_contexts, "context")

    def settle(batches):
        for batch in batches:
            out = []
            for kind, a, b, c, *s in zip(*(batch.column(i).to_pylist() for i in (0, *range(2, 8)))):
                whole, alpha = _backoff(*(np.array([x]) for x in s))
                seen, unseen = -np.log10(max(whole[0], 1)), np.log10(alpha[0])
                if kind == 4:
                    out.append((np.frombuffer(b, np.float64) + np.where(np.frombuffer(c, bool), unseen, seen)).tobytes())
                    continue
                n = np.frombuffer(b, np.float64).reshape(2, -1)
                out.append((n[0] * seen + n[1] * unseen).tobytes())
            kinds = [4 if k == 4 else 1 for k in batch.column(0).to_pylist()]
            none = pa.nulls(len(out), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), batch.column(1), batch.column(2), pa.array(out, pa.binary()), none, none], ["kind", "chunk", "a", "b", "c", "d"])

    rows_ = "kind int, chunk long, a binary, b binary, c binary, d binary"
    settled = pending.select("kind", "chunk", "a", "b", "c", "total", "spent", "covered").mapInArrow(settle, rows_)
    parts_of = judged.filter("kind < 2").select("kind", "chunk", "a", "b", "c", "d").unionByName(settled)
    ids = docs.mapInArrow(_ids, f"chunk long, place long, doc_id {docs.schema['doc_id'].dataType.simpleString()}")

    def add_up(key, part):
        held, tokens, total = None, None, None
        kinds = part.column("kind").to_pylist()
        a, b, c, d = (part.column(x).to_pylist() for x in "abcd")
        i = kinds.index(0)
        tokens, held = np.frombuffer(a[i], np.int64), np.frombuffer(b[i], bool)
        base, known = np.frombuffer(c[i], np.float64).reshape(2, -1)
        total = np.stack((np.zeros(len(tokens)), base, known))
        entry, doc, times = np.frombuffer(d[i], np.uint32).reshape(3, -1).astype(np.int64)
        value = np.zeros(int(entry.max()) + 1 if len(entry) else 0)
        for i, kind in enumerate(kinds):
            if kind == 1:
                total[0, np.frombuffer(a[i], np.uint16)] += np.frombuffer(b[i], np.float64)
                if c[i] is not None:
                    total[1:, np.frombuffer(c[i], np.uint16)] += np.frombuffer(d[i], np.float64).reshape(2, -1)
            elif kind == 4:
                value[np.frombuffer(a[i], np.uint32)] = np.frombuffer(b[i], np.float64)
        total[0] += np.bincount(doc, value[entry] * times, len(tokens))
        n = len(tokens)
        return pa.table([pa.array([key[0].as_py()] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(held), pa.array(tokens),
                         pa.array(np.rint(total[2]).astype(np.int64)), pa.array(total[1]), pa.array(total[0])],
                        ["chunk", "place", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = parts_of.groupBy("chunk").applyInArrow(add_up, "chunk long, place long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    trained = F.lit(uni.tokens).cast("long").alias("train_tokens")
    empty = F.lit(uni.tokens == 0)
    return scored.join(ids, ["chunk", "place"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", trained,
        F.when(empty, 0.0).otherwise(F.col("base_score")).alias("base_score"), F.when(empty, 0.0).otherwise(F.col("score")).alias("score"))


def _ids(batches):
    """Chunk and place of every document, as ``deal`` numbers them."""
    partition = TaskContext.get().partitionId()
    for number, batch in enumerate(_chunks(batches)):
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([(partition << 32) + number] * n, pa.int64()), pa.array(range(n), pa.int64()), batch.column(2)], ["chunk", "place", "doc_id"])


def _backoff(total, spent, covered):
    """Occurrences to divide by and the backoff weight of contexts, from their sums over seen followers."""
    whole = np.where(total - spent > 1e-9 * np.maximum(total, 1), total, total + 1)
    left = np.where(total > 0, (whole - spent) / np.maximum(whole, 1), 1.0)
    return whole, left / np.maximum(1 - covered, 1e-12)


@query("op3_katz")
def op3(spark, folder):
    from tuneframe.llm.langid import held_out

    docs = table(spark, folder, "documents")
    return score(docs.select("doc_id", "text", held_out(F.col("doc_id"), 5, 1).alias("held_out")))
