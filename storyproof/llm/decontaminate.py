"""Benchmark decontamination over a positional inverted index.

The index is made in one pass over the texts and stored in the shared folder: for each document the postings of its terms, each
term with its positions; a benchmark that is known beforehand can limit them to its own terms. It is sharded by document, so
making and searching it shuffle only term counts. A search reads the stored postings alone: each distinct window of the items
starts from its rarest term (or from several, for proximity matches), shifts that list by the term's offset in the window, and
keeps the places which the lists of the next rarer terms, shifted likewise, confirm. Windows are held by all tasks, so many
times as they fit: more than that are searched in parts, over the same index, each window in one part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from storyproof.llm.common import Words, arrow_map, column, documents, materialize, payloads, slices

WINDOW, SLOP, SHARE = 10, 2, 0.8
#: The windows, and pairs of a window and an item, that one search holds: about 100 bytes each in every task.
WINDOWS, PAIRS = 500_000, 1_000_000
#: Items of a window that are one row.
ITEMS = 10_000
#: The terms that an index is limited to; for more, it holds all terms of the texts.
TERMS = 4_000_000
SLICE = 500_000
INDEX = "uid long, doc_id long, n_words long, terms array<long>, ends array<int>, positions array<int>"
FOUND = "uid long, doc_id long, n_words long, items array<string>, spans array<struct<start:long,end:long>>, n_near long, near array<struct<item:string,start:long,end:long>>"


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind or pa.int32()))


def index(docs: DataFrame, vocabulary: np.ndarray | None = None, keep: int = 0) -> DataFrame:
    """INDEX rows of docs (uid, doc_id, text, others): the postings of all terms, or of those with the given sorted hashes.

    A term is the 64-bit hash of a word. The last columns of docs, as many as keep says, are stored beside the postings, so
    that whoever wants them need not join texts to findings.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kept = docs.columns[len(docs.columns) - keep :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, names = known.value, [x.split()[0] for x in INDEX.split(", ")] + kept
        if hashes is not None:
            maybe = np.zeros(1 << 20, dtype=bool)
            maybe[hashes >> np.uint64(44)] = True
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            texts, docs_of, uids = payloads(b.column(2)), b.column(1), b.column(0)
            others = [b.column(c) for c in kept]
            for lo, hi in slices(map(len, texts), SLICE):
                w = Words(texts[lo:hi])
                if hashes is None:
                    near = np.arange(len(w.hash))
                else:
                    near = np.flatnonzero(maybe[w.hash >> np.uint64(44)])
                    near = near[_places(hashes, w.hash[near]) >= 0]
                text, term = w.text[near], w.hash[near]
                order = np.lexsort([term, text])
                text, term, position = text[order], term[order], (near - w.first[text])[order]
                last = np.flatnonzero(np.append((text[1:] != text[:-1]) | (term[1:] != term[:-1]), [True] * bool(len(text))))  # of each list
                of_doc = np.searchsorted(text[last], np.arange(1, hi - lo + 1))
                base = np.searchsorted(text, np.arange(hi - lo))
                ids = pa.array(np.arange(at, at + hi - lo)) if uids.null_count else uids.slice(lo, hi - lo)
                at += hi - lo
                yield pa.RecordBatch.from_arrays([ids, docs_of.slice(lo, hi - lo), pa.array(np.diff(w.first)), _lists(term[last].view(np.int64), of_doc, pa.int64()), _lists(last + 1 - base[text[last]], of_doc), _lists(position, np.searchsorted(text, np.arange(1, hi - lo + 1))), *(c.slice(lo, hi - lo) for c in others)], names)

    return materialize(arrow_map(docs, run, _with(INDEX, docs, kept)), "postings")


def _places(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each of some values stands in a sorted array, -1 where it doesn't."""
    if not len(known):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, -1)


def term_counts(postings: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each of the terms with the given sorted hashes occurs in the index; only these counts reach the driver."""
    held = postings.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(held.value), dtype=np.int64)
        for b in batches:
            terms, size = _postings(b.column(0), b.column(1))
            place = _places(held.value, terms)
            np.add.at(totals, place[place >= 0], size[place >= 0])
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used])], ["term", "n"])

    sums = arrow_map(postings.select("terms", "ends"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary), dtype=np.int64)
    out[sums["term"].to_numpy()] = sums["n"].to_numpy()
    return out


def _postings(terms: pa.Array, ends: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The terms of all documents of a batch as hashes, and the length of each one's list."""
    lists = terms.value_lengths().to_numpy()
    term, end = terms.flatten().to_numpy().view(np.uint64), ends.flatten().to_numpy().astype(np.int64)
    first = (np.cumsum(lists) - lists)[lists > 0]
    size = np.diff(end, prepend=0)
    size[first] = end[first]
    return term, size


def _with(schema: str, df: DataFrame, columns: list[str]) -> StructType:
    return StructType([*StructType.fromDDL(schema), *(df.schema[c] for c in columns)])


class Plan:
    """Some distinct windows, each with its terms from the rarest on; an anchor is the rarest term of a window.

    Of the rarest length - least + 1 terms of a window, every proximity match holds one, where least is the number of terms
    that it needs: those are the near anchors. It is made of arrays: a row a window, and the items of all windows in a row.
    """

    def __init__(self, rows: pa.Table, vocabulary: np.ndarray, counts: np.ndarray, window: int, share: float):
        """rows (terms array<long>, items array<string>, head), as windows() gives them, over the sorted hashes of the vocabulary."""
        terms, items = (rows[c].combine_chunks() for c in ("terms", "items"))
        self.vocabulary = vocabulary
        n = rows.num_rows
        self.length = terms.value_lengths().to_numpy().astype(np.int64)
        inside = np.arange(window) < self.length[:, None]
        found = np.full((n, window), -1, dtype=np.int32)
        found[inside] = np.searchsorted(vocabulary, terms.flatten().to_numpy().view(np.uint64))
        often = np.where(inside, counts[found] if len(counts) else 0, np.iinfo(np.int64).max)
        order = np.argsort(often, axis=1, kind="stable")
        self.terms, self.offsets = np.take_along_axis(found, order, 1), order.astype(np.int16)
        self.head = rows["head"].to_numpy()
        names = items.flatten().dictionary_encode()
        self.names, self.name_of = names.dictionary.to_pylist(), names.indices.to_numpy().astype(np.int32)
        self.names_end = np.cumsum(items.value_lengths().to_numpy())
        self.least = np.ceil(share * self.length - 1e-9).astype(np.int64)
        which, nth = np.nonzero(np.arange(window) < (self.length - self.least + 1)[:, None])
        order = np.argsort(self.terms[which, nth], kind="stable")
        self.near_which, self.near_offset = which[order].astype(np.int32), self.offsets[which, nth][order]
        self.near_anchors = self.terms[which, nth][order]
        self.by_anchor = np.argsort(self.terms[:, 0], kind="stable")
        self.anchors = self.terms[self.by_anchor, 0]

    def items(self, window: int) -> list[str]:
        """The ids of the items that have a window."""
        return [self.names[i] for i in self.name_of[self.names_end[window - 1] if window else 0 : self.names_end[window]]]


def proximity(p: Plan, line: np.ndarray, at: np.ndarray, of: np.ndarray, docs: np.ndarray, window: int, slop: int) -> list[tuple[int, int, int]]:
    """(document, window, start on line) of each proximity match, for the places at of the terms of, in the documents docs."""
    left, right = np.searchsorted(p.near_anchors, of), np.searchsorted(p.near_anchors, of, side="right")
    some = np.flatnonzero(right > left)
    many = (right - left)[some]
    rows: list[np.ndarray] = []

    def enough(which: np.ndarray, start: np.ndarray, reach: int, *others: np.ndarray) -> tuple[np.ndarray, ...]:
        """Those with enough terms within reach of their places, and the number of these terms; others are filtered alike."""
        count, n = np.zeros(len(which), dtype=np.int64), p.length[which]
        for j in range(window):
            place = start + p.offsets[which, j]
            met = np.zeros(len(which), dtype=bool)
            for s in range(-reach, reach + 1):
                met |= line[np.clip(place + s, 0, len(line) - 1)] == p.terms[which, j]
            count += met & (j < n)
            fit = count + np.maximum(n - j - 1, 0) >= p.least[which]
            which, start, count, n = which[fit], start[fit], count[fit], n[fit]
            others = tuple(x[fit] for x in others)
        return which, start, count, *others

    for lo, hi in slices(many.tolist(), SLICE):
        size = many[lo:hi]
        pairs = np.repeat(left[some[lo:hi]], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        which, doc = p.near_which[pairs], np.repeat(docs[some[lo:hi]], size)
        # an anchor can stand slop words off: whatever matches then has its terms within twice that of the anchor's own start
        which, start, _, doc = enough(which, np.repeat(at[some[lo:hi]], size) - p.near_offset[pairs], 2 * slop, doc)
        for s in range(-slop, slop + 1):
            w, b, n, d = enough(which, start + s, slop, doc)
            rows.append(np.stack([d, w, b, -n]))
    found = np.unique(np.concatenate(rows, axis=1), axis=1) if rows else np.zeros((4, 0), dtype=np.int64)
    if not found.shape[1]:
        return []
    doc, which, start, few = found
    aligned = np.zeros(len(doc), dtype=np.int64)
    for j in range(window):
        aligned += (j < p.length[which]) & (line[np.clip(start + p.offsets[which, j], 0, len(line) - 1)] == p.terms[which, j])
    exact = aligned == p.length[which]
    group = np.cumsum((np.diff(doc, prepend=-1) != 0) | (np.diff(which, prepend=-1) != 0) | (np.diff(start, prepend=start[0]) > slop))
    best = np.lexsort([start, -aligned, few, group])
    best = best[np.flatnonzero(np.diff(group[best], prepend=-1))]
    best = best[~np.isin(group[best], group[exact])]
    return list(zip(doc[best].tolist(), which[best].tolist(), start[best].tolist(), strict=True))


def search(postings: DataFrame, plan: Plan, window: int, slop: int) -> DataFrame:
    """FOUND rows, and what the index has kept beside: the items with a window in the document, the spans of words inside any, and the proximity matches: their number, and item and span of each.

    A proximity match is a place where at least the plan's share of a window's terms, but not all at their offsets, stand
    within slop words of their offset-adjusted places. Of such places of one window, each at most slop words after the one
    before, the one with most terms counts, of several that with most at their offsets, the first of those; none does if the window stands among them exactly. A window
    of several items is one match, listed under each.
    """
    held = postings.sparkSession.sparkContext.broadcast(plan)
    kept = postings.columns[INDEX.count(", ") + 1 :]
    struct = pa.struct([("item", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, names, pad = held.value, [x.split()[0] for x in FOUND.replace("item:string,start:long,end:long", "").replace("start:long,end:long", "").split(", ")] + kept, window + 2 * slop + 1
        for b in batches:
            n_words = b.column(2).to_numpy()
            for lo, hi in slices(n_words.tolist(), SLICE):
                base = np.cumsum(np.concatenate([[pad], n_words[lo:hi] + pad]))  # where each document begins on one line of words
                line = np.full(base[-1] + pad, -2, dtype=np.int32)
                terms, ends, positions = (b.column(i).slice(lo, hi - lo) for i in (3, 4, 5))
                term, size = _postings(terms, ends)
                of = np.repeat(_places(p.vocabulary, term), size)
                at = np.repeat(base[:-1], positions.value_lengths().to_numpy()) + positions.flatten().to_numpy()
                at, of = at[of >= 0], of[of >= 0].astype(np.int32)
                line[at] = of
                left, right = np.searchsorted(p.anchors, of), np.searchsorted(p.anchors, of, side="right")
                some = np.flatnonzero(right > left)
                many = (right - left)[some]
                which = p.by_anchor[np.repeat(left[some], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                start = np.repeat(at[some], many) - p.offsets[which, 0]
                inside = start >= pad  # else it would begin before the first document
                which, start = which[inside], start[inside]
                exact = np.arange(len(which))
                for j in range(1, window):
                    exact = exact[(j >= p.length[which[exact]]) | (line[start[exact] + p.offsets[which[exact], j]] == p.terms[which[exact], j])]
                document = lambda x: np.searchsorted(base, x, side="right") - 1
                n_near, near = [0] * (hi - lo), [[] for _ in range(hi - lo)]
                for d, w, place in proximity(p, line, at, of, document(at), window, slop):
                    n_near[d] += int(p.head[w])
                    begin, end = max(place, int(base[d])), min(place + int(p.length[w]), int(base[d] + n_words[lo + d]))
                    near[d] += [{"item": x, "start": begin - int(base[d]), "end": end - int(base[d])} for x in p.items(w)]
                cover = np.zeros(len(line) + 1, dtype=np.int32)
                np.add.at(cover, start[exact], 1)
                np.add.at(cover, start[exact] + p.length[which[exact]], -1)
                edges = np.flatnonzero(np.diff(np.cumsum(cover) > 0, prepend=False))
                runs = edges.reshape(-1, 2)
                items: list[list[str]] = [[] for _ in range(hi - lo)]
                spans: list[list[dict]] = [[] for _ in range(hi - lo)]
                for d, s, e in zip(document(runs[:, 0]).tolist(), *runs.T.tolist(), strict=True):
                    spans[d].append({"start": s - int(base[d]), "end": e - int(base[d])})
                met_at = np.unique(np.stack([document(start[exact]), which[exact]]), axis=1)
                for d, w in met_at.T.tolist():
                    items[d] += p.items(w)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(3)), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(n_near, pa.int64()), pa.array([sorted(x, key=lambda y: tuple(y.values())) for x in near], pa.list_(struct)), *(b.column(c).slice(lo, hi - lo) for c in kept)], names)

    return arrow_map(postings, run, _with(FOUND, postings, kept))


def windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct windows of the items of bench (item_id, text): (terms, items, head), the hashes of their words and the sorted ids.

    An item of fewer words than a window is one window; one without id or words has none. Items are cut where they are read
    and meet by window, so an item may have any size. A window of more than about ITEMS items is several rows, each with some
    of them; one of these is the head, which stands for the window where windows are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = payloads(b.column(1)), b.column(0)
            for lo, hi in slices(map(len, texts), SLICE):
                w = Words(texts[lo:hi])
                n = np.diff(w.first)
                length = np.minimum(n, window)
                many = np.where(n > 0, n - length + 1, 0)
                item = np.repeat(np.arange(hi - lo), many)
                start = w.first[item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
                size = length[item]
                for i in range(0, len(item), SLICE // window + 1):
                    part = slice(i, i + SLICE // window + 1)
                    at = np.repeat(start[part], size[part]) + np.arange(size[part].sum()) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(item[part])), _lists(w.hash[at].view(np.int64), np.cumsum(size[part]), pa.int64())], ["item", "terms"])

    items = bench.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    cut = arrow_map(items, run, "item string, terms array<long>").distinct()
    cut = materialize(cut, "cut-windows")
    often = cut.groupBy("terms").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("least")).where(F.col("n") > ITEMS)
    shares = often.select("terms", "least", F.ceil(F.col("n") / ITEMS).alias("shares"))
    share = lambda c: F.pmod(F.xxhash64(c), F.coalesce("shares", F.lit(1)))
    dealt = cut.join(shares, "terms", "left").withColumns({"share": share("item"), "head": F.coalesce(share("item") == share("least"), F.lit(True))})
    return materialize(dealt.groupBy("terms", "share", "head").agg(F.array_sort(F.collect_list("item")).alias("items")).select("terms", "items", "head"), "windows")


def _vocabulary(terms: DataFrame) -> np.ndarray:
    return np.sort(terms.toArrow()["term"].to_numpy().view(np.uint64))


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, slop: int = SLOP, share: float = SHARE, keep: bool = False) -> DataFrame:
    """FOUND rows, one for each row of docs (doc_id, text), for the items of bench (item_id, text).

    Words are compared by 64-bit hashes. Null or empty texts have no words; an item of fewer words than a window is one
    window, and one without words or id is none. Items of one id are one item, equal windows of several items one window. The
    windows are dealt into parts of at most about WINDOWS windows and PAIRS of them with items; each part is searched over the
    same index, and where there are several, their findings are merged by document: the result is the same however many there
    are. Repeated rows keep their rows. An empty table gives none; an empty bench finds nothing. Other columns are ignored,
    unless keep is set: then all columns of docs follow, named kept_ and their place.
    """
    others = [column(c).alias(f"kept_{i}") for i, c in enumerate(docs.columns)] if keep else []
    docs = docs.select(F.lit(None).cast("long").alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text", *others)
    cut = windows(bench, window)
    n, pairs = cut.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    parts = max(1, -(-n // WINDOWS), -(-pairs // PAIRS))
    terms = cut.select(F.explode("terms").alias("term")).distinct()
    limited = _vocabulary(terms) if terms.count() <= TERMS else None
    postings = index(docs, limited, len(others))

    def found(part: DataFrame, postings: DataFrame) -> DataFrame:
        rows = part.toArrow()
        vocabulary = np.unique(rows["terms"].combine_chunks().flatten().to_numpy().view(np.uint64))
        return search(postings, Plan(rows, vocabulary, term_counts(postings, vocabulary), window, share), window, slop)

    if parts == 1:
        return found(cut, postings)
    slim, all_found = postings.select(*postings.columns[: INDEX.count(", ") + 1]), None
    for i in range(parts):
        some = materialize(found(cut.where(F.pmod(F.xxhash64("terms", "items"), F.lit(parts)) == i), slim), "found")
        all_found = all_found.unionByName(some) if all_found else some
    once = [F.first(c).alias(c) for c in ("doc_id", "n_words")]
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), _merged(F.flatten(F.collect_list("spans"))).alias("spans"), F.sum("n_near").alias("n_near"), F.array_sort(F.flatten(F.collect_list("near"))).alias("near")]
    merged = all_found.groupBy("uid").agg(*once, *lists)
    return merged.join(postings.select("uid", *(c for c in postings.columns if c.startswith("kept_"))), "uid") if others else merged


def _merged(spans: Column) -> Column:
    """Spans with those that overlap or touch joined."""
    last = lambda out: F.try_element_at(out, F.lit(-1))

    def add(out: Column, x: Column) -> Column:
        longer = F.struct(last(out)["start"].alias("start"), F.greatest(last(out)["end"], x["end"]).alias("end"))
        joins = (F.size(out) > 0) & (last(out)["end"] >= x["start"])
        return F.when(joins, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(longer))).otherwise(F.array_append(out, x))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:long,end:long>>"), add)


def report(found: DataFrame) -> DataFrame:
    """FOUND rows with counts and a digest in place of the lists; n_near and near follow."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "n_near", "near")


def digest(items: list[str]) -> str:
    """items_sha256 of some item ids, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report() of documents against benchmark: a row a document, null and empty texts with zeros."""
    return report(contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
