"""Known-item query sets, gated against all chunks in one job.

A candidate query counts if few documents match it, its own among them. As the
matching chunks are looked at in the order of their documents and only so many of
them, the first few documents of a query decide: no task holds more of a term,
however common it is.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkfathom.functions import analysis, chunking
from sparkfathom.functions import text as T
from sparkfathom.operators import evaluation as E
from sparkfathom.sources.tables import kept

#: Chunks that rare tokens come from and candidates tried; the same for phrases, which skip the first chunks.
TOKEN_CHUNKS, TOKENS_TRIED = 8, 10
PHRASE_SKIP, PHRASE_CHUNKS, PHRASES_TRIED = 2, 6, 12

#: Queries up to which their table is broadcast (a query has six words at most); more are joined by an exchange.
BROADCAST_QUERIES = 50_000

#: Words of chunks, or bytes of texts, that a task takes at once, and bits of the filter of asked words.
HELD_WORDS, HELD_BYTES, FILTER_BITS = 1_000_000, 8_000_000, 1 << 26

#: Bytes of simple lexemes and of white space.
LEXEME, SPACE = (np.isin(np.arange(256), list(signs)) for signs in (b"abcdefghijklmnopqrstuvwxyz0123456789", b" \t\n\x0b\f\r"))


class Windows(NamedTuple):
    """Chunks that are windows of the words of whole texts, as ``chunking.chunk_words`` makes them.

    What needs words only takes them from a text once, not from each window.
    """

    texts: DataFrame
    doc: str
    text: str
    size: int
    overlap: int

    def head(self, windows: int) -> DataFrame:
        """The texts up to the end of their first windows."""
        last = chunking.window_range(self.size, self.overlap, 0, windows)[1]
        words = F.filter(F.slice(F.split(self.text, r"\s+", last + 2), 1, last + 1), lambda w: w != "")  # the first may be empty
        return self.texts.select(self.doc, F.array_join(F.slice(words, 1, last), " ").alias(self.text))

    def chunks(self, index: str, content: str, first: int | None = None) -> DataFrame:
        """``doc, index, content``; with ``first`` texts are cut after their first windows, before these are made."""
        texts = self.texts if first is None else self.head(first)
        made = chunking.chunk_words(texts, [self.doc], self.text, self.size, self.overlap)
        return made.select(self.doc, F.col("chunk_index").alias(index), F.col("content").alias(content))

    def documents(self) -> DataFrame:
        """Documents with a chunk."""
        return self.texts.where(F.col(self.text).rlike(r"\S")).select(self.doc)


def gated(asked: DataFrame, matches: DataFrame, most: int = E.KNOWN_ITEM_DOCUMENTS, rows: int = E.MATCH_ROWS) -> DataFrame:
    """The rows of ``asked`` (``query, gold, ..``) that identify their gold document.

    ``matches`` has ``query, document`` for each chunk that matches, or rows that say how
    many ``chunks`` of the document do. Of a query the first
    ``rows`` chunks count, by document; they may lie in ``most`` documents, and the gold
    one must be one of them. What comes after a query's first ``most + 1`` documents is
    dropped in each task, before the one exchange of matches. The last join is on query
    and gold, so a common query is no hot key.
    """
    by = Window.partitionBy("query").orderBy("document")
    chunks = F.col("chunks") if "chunks" in matches.columns else F.lit(1)
    first = matches.select("query", "document", chunks.alias("chunks")).withColumn("__n", F.dense_rank().over(by)).where(F.col("__n") <= most + 1)
    first = first.groupBy("query", "document").agg(F.sum("chunks").alias("chunks"))
    before = F.coalesce(F.sum("chunks").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = first.withColumn("__before", before).where(F.col("__before") < rows)
    small = counted.groupBy("query").agg(F.collect_list("document").alias("__held")).where(F.size("__held") <= most)
    return asked.join(small.select("query", F.explode("__held").alias("gold")), ["query", "gold"])


def first_by_document(accepted: DataFrame) -> DataFrame:
    """``gold, place, query``: the first accepted candidate of each document."""
    best = accepted.groupBy("gold").agg(F.min(F.struct("place", "shown")).alias("b"))
    return best.select("gold", F.col("b.place").alias("place"), F.col("b.shown").alias("query"))


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Keys in order, each once; a sort, as ``np.unique`` hashes, which takes ten times as long."""
    keys.sort()
    return keys[np.flatnonzero(np.diff(keys, prepend=-1))]


class _Block(NamedTuple):
    """Some documents; the document of each of their chunks; words; and of each word in a chunk the word and the chunk."""

    documents: pa.Array | pa.ChunkedArray
    owner: np.ndarray
    words: pa.Array | pa.ChunkedArray
    word: np.ndarray
    chunk: np.ndarray


def _of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    """From rows ``document, terms`` of chunks."""
    documents, lengths, words, n = [], [], [], 0

    def block() -> _Block:
        each = np.concatenate(lengths)
        return _Block(pa.chunked_array(documents), np.arange(len(each)), pa.chunked_array(words), np.arange(n), np.repeat(np.arange(len(each)), each))

    for batch in batches:
        documents.append(batch.column(0))
        lengths.append(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy().astype(np.int64))
        words.append(pc.list_flatten(batch.column(1)))
        n += len(words[-1])
        if n >= HELD_WORDS:
            yield block()
            documents, lengths, words, n = [], [], [], 0
    if n:
        yield block()


def _of_texts(size: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[_Block]]:
    """From rows ``document, text`` of whole lower-cased texts, in bytes: the simple lexemes of all their windows."""
    step = size - overlap

    def block(documents: pa.Array, texts: pa.Array) -> _Block:
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
        data = np.frombuffer(b"".join(pc.drop_null(texts).to_pylist()), np.uint8)
        inner = ends[(ends > 0) & (ends < len(data))]  # a text ends words

        def starts(held: np.ndarray) -> np.ndarray:
            first = held.copy()
            first[1:] &= ~held[:-1]
            first[inner] = held[inner]
            return np.flatnonzero(first)

        lexeme, words = LEXEME[data], starts(~SPACE[data])
        at = starts(lexeme)
        of = np.searchsorted(ends, at, side="right")
        before = np.searchsorted(words, np.append(0, ends))  # words of the texts before
        total = np.diff(before)
        windows = np.where(total > 0, 1 + np.maximum(-(-(total - size) // step), 0), 0)
        place = np.searchsorted(words, at, side="right") - 1 - before[of]
        low, high = np.maximum((place - size + step) // step, 0), np.minimum(place // step, windows[of] - 1)
        times = high - low + 1
        word = np.repeat(np.arange(len(at)), times)
        chunk = (np.cumsum(windows) - windows)[of] + low - (np.cumsum(times) - times)
        offsets = np.append(np.searchsorted(np.flatnonzero(lexeme), at), np.count_nonzero(lexeme))
        found = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[lexeme]))
        return _Block(documents, np.repeat(np.arange(len(documents)), windows), found, word, chunk[word] + np.arange(len(word)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + HELD_BYTES, side="right")))
                yield block(batch.column(0).slice(start, stop - start), texts.slice(start, stop - start))
                start = stop

    return run


def _counted(chunks: DataFrame | Windows, doc: str, content: str, analyzer: str, coded: Callable, kind: str, most: int) -> DataFrame:
    """``query, document, chunks``: of a query its first ``most + 1`` documents in each block, with their chunks that match.

    ``coded`` makes the queries of a block, and pairs of a query's number and a chunk that matches, each once.
    """
    if isinstance(chunks, Windows) and analyzer == "simple":
        given, blocks = chunks.texts.select(F.col(chunks.doc).alias("document"), F.lower(chunks.text)), _of_texts(chunks.size, chunks.overlap)
    else:
        chunks = chunks.chunks("i", content) if isinstance(chunks, Windows) else chunks
        given, blocks = chunks.select(F.col(doc).alias("document"), analysis.lexemes(F.col(content), analyzer)), _of_chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            queries, code, chunk = coded(block)
            ordered = pc.unique(block.documents)
            ordered = ordered.take(pc.sort_indices(ordered, null_placement="at_start"))
            key = code * len(ordered) + pc.index_in(block.documents, ordered).to_numpy().astype(np.int64)[block.owner[chunk]]
            key.sort()
            first = np.flatnonzero(np.diff(key, prepend=-1))
            n = np.diff(first, append=len(key))
            code, document = key[first] // len(ordered), key[first] % len(ordered)
            new = np.flatnonzero(np.diff(code, prepend=-1))
            early = np.arange(len(code)) - np.repeat(new, np.diff(new, append=len(code))) <= most
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(code[early])), ordered.take(pa.array(document[early])), pa.array(n[early].astype(np.int64))], ["query", "document", "chunks"])

    return given.mapInArrow(run, f"query {kind}, document {given.schema['document'].dataType.simpleString()}, chunks long")


def _asked_words(asked: DataFrame) -> np.ndarray:
    """A filter: the bits that checksums of the asked words set."""
    at = F.pmod(F.crc32("query"), F.lit(FILTER_BITS))
    held = asked.select(F.floor(at / 32).alias("at"), F.pmod(at, F.lit(32)).cast("int").alias("bit"))
    held = held.groupBy("at").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[held.column("at").to_numpy()] = held.column("bits").to_numpy()
    return out


def term_documents(chunks: DataFrame | Windows, asked: DataFrame, doc: str, content: str, analyzer: str = "simple", most: int = E.KNOWN_ITEM_DOCUMENTS) -> DataFrame:
    """``query, document, chunks``: how many chunks of a document hold a word of ``asked``; other words may come too.

    Chunks are counted where they are read. Of what a task takes at once, a word's first
    ``most + 1`` documents are passed on; the first ones of all are among them.
    """
    bits = _asked_words(asked)

    def coded(block: _Block) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        words = block.words.dictionary_encode()
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        at = np.fromiter((zlib.crc32(w) % FILTER_BITS for w in words.dictionary.cast(pa.large_binary()).to_pylist()), np.int64, len(words.dictionary))
        held = (bits[at // 32] >> (at % 32).astype(np.uint32) & 1).astype(bool)
        code = words.indices.to_numpy().astype(np.int64)[block.word]
        pairs = _distinct((code * len(block.owner) + block.chunk)[held[code]])
        return words.dictionary.cast(pa.string()), pairs // max(1, len(block.owner)), pairs % max(1, len(block.owner))

    return _counted(chunks, doc, content, analyzer, coded, "string", most)


def token_candidates(chunks: DataFrame, doc: str, index: str, content: str, first: int = TOKEN_CHUNKS, tried: int = TOKENS_TRIED) -> DataFrame:
    """``gold, place, shown``: capitalised words of a document's first chunks, longest first, ties by code points."""
    early = chunks.where(F.col(index) < first).select(F.col(doc).alias("gold"), T.capitalised_tokens(F.col(content)).alias("t"))
    own = early.groupBy("gold").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("t"))
    ordered = F.array_sort(F.transform("t", lambda t: F.struct((-F.char_length(t)).alias("short"), t.alias("token"))))
    placed = own.select("gold", F.posexplode(F.slice(ordered, 1, tried)).alias("place", "x"))
    return placed.select("gold", "place", F.col("x.token").alias("shown"))


def rare_token_set(chunks: DataFrame | Windows, doc: str, index: str, content: str, analyzer: str = "simple") -> DataFrame:
    """``gold, place, query``: for each document its first capitalised word that few documents hold.

    All documents are asked at once. Documents without an accepted word are left out, null texts have none.
    """
    early = chunks
    if isinstance(chunks, Windows):  # windows end between words, so the words of the first ones are those of their span
        early = chunks.head(TOKEN_CHUNKS).select(F.col(chunks.doc).alias(doc), F.lit(0).alias(index), F.col(chunks.text).alias(content))
    asked = token_candidates(early, doc, index, content).withColumn("query", F.get(analysis.lexemes(F.col("shown"), analyzer), 0))
    asked = kept(asked.where("query is not null"))
    return first_by_document(gated(asked, term_documents(chunks, asked, doc, content, analyzer)))


def phrase_asked(chunks: DataFrame, doc: str, index: str, content: str, analyzer: str = "simple") -> DataFrame:
    """``gold, place, shown, query``: the first phrases of a document's later chunks; ``query`` holds their distinct words."""
    later = chunks.where(F.col(index).between(PHRASE_SKIP, PHRASE_SKIP + PHRASE_CHUNKS - 1))
    found = later.select(F.col(doc).alias("gold"), F.struct(F.col(index).alias("i"), F.slice(T.phrase_candidates(F.col(content)), 1, PHRASES_TRIED).alias("p")).alias("x"))
    own = found.groupBy("gold").agg(F.flatten(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["p"])).alias("p"))
    placed = own.select("gold", F.posexplode(F.slice("p", 1, PHRASES_TRIED)).alias("place", "shown"))
    terms = F.array_sort(F.array_distinct(analysis.lexemes(F.col("shown"), analyzer)))
    return placed.withColumn("query", terms).where(F.size("query") > 0)


def phrase_documents(chunks: DataFrame | Windows, queries: DataFrame, doc: str, content: str, analyzer: str = "simple", most: int = E.KNOWN_ITEM_DOCUMENTS) -> DataFrame:
    """``query, document, chunks``: how many chunks of a document hold all words of a query.

    A query is an array of distinct words. The queries go to the tasks; of what a task takes
    at once, chunks are met by a query's rarest word there, then hold against the others,
    and a query's first ``most + 1`` documents are passed on. Null documents do not count.
    """
    known = F.col(doc).isNotNull()
    chunks = chunks._replace(texts=chunks.texts.where(known)) if isinstance(chunks, Windows) else chunks.where(known)
    given = queries.select("query").distinct().toArrow()
    names = given.column(0).combine_chunks().cast(pa.list_(pa.string()))
    sizes = pc.list_value_length(names).to_numpy().astype(np.int64)
    terms = pc.list_flatten(names).dictionary_encode()
    vocabulary = terms.dictionary
    held = np.full((len(names), max(sizes, default=1)), -1)  # the words of each query by number
    held[np.arange(held.shape[1]) < sizes[:, None]] = terms.indices.to_numpy()

    def coded(block: _Block) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        found = pc.fill_null(pc.index_in(block.words, vocabulary.cast(block.words.type)), -1).to_numpy().astype(np.int64)[block.word]
        n = len(block.owner)
        posts = _distinct((found * n + block.chunk)[found >= 0])  # by word, then by chunk
        first = np.searchsorted(posts, np.arange(len(vocabulary) + 1) * n)
        df = np.append(np.diff(first), np.iinfo(np.int64).max)  # the last for what is no word
        ordered = np.take_along_axis(held, np.argsort(df[held], axis=1), axis=1)  # rarest first
        least = df[ordered[:, 0]]
        asked = np.flatnonzero(least > 0)
        pairs, start, ends = [], 0, np.cumsum(least[asked])
        while start < len(asked):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + HELD_WORDS, side="right")))
            query, times = asked[start:stop], least[asked[start:stop]]
            at = np.repeat(first[ordered[query, 0]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            query, chunk = np.repeat(query, times), posts[at] % n
            for word in ordered.T[1:]:
                key = word[query] * n + chunk
                whole = (word[query] < 0) | (posts[np.minimum(np.searchsorted(posts, key), len(posts) - 1)] == key)
                query, chunk = query[whole], chunk[whole]
            pairs.append((query, chunk))
            start = stop
        query, chunk = (np.concatenate([p[i] for p in pairs]) if pairs else np.empty(0, np.int64) for i in (0, 1))
        return names, query, chunk

    return _counted(chunks, doc, content, analyzer, coded, "array<string>", most)


def conjunctions(chunks: DataFrame, queries: DataFrame, doc: str, index: str, content: str, analyzer: str = "simple") -> DataFrame:
    """``query, document``: a row for each chunk that holds all words of a query.

    The way for more queries than go to the tasks: chunks are exchanged, met by a
    query's rarest word only, then hold against the others.
    """
    sets = chunks.select(F.col(doc).alias("document"), F.col(index).alias("i"), F.array_distinct(analysis.lexemes(F.col(content), analyzer)).alias("terms"))
    posts = sets.select("document", "i", F.explode("terms").alias("term"))
    words = queries.select(F.col("query"), F.explode("query").alias("term"))
    df = posts.join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarest = words.join(df, "term").groupBy("query").agg(F.min(F.struct("df", "term")).alias("r"), F.count(F.lit(1)).alias("n"))
    probes = rarest.where(F.col("n") == F.size("query")).select("query", F.col("r.term").alias("term"))
    met = posts.join(probes, "term").select("document", "i", "query")
    whole = met.join(sets, ["document", "i"]).where(F.size(F.array_except("query", "terms")) == 0)
    return whole.select("query", "document")


def phrase_set(chunks: DataFrame | Windows, doc: str, index: str, content: str, n: int, order: Column, analyzer: str = "simple") -> DataFrame:
    """``gold, place, query``: for ``n`` documents their first phrase that few documents match.

    Documents are asked in the order of ``order``, an expression of ``doc``, four times
    as many as are wanted at first; while too few are accepted, those after them, up to
    four times more. So the work is a pass over all chunks for a stated number of queries;
    fewer than ``n`` rows come only if all documents were asked. ``order`` must tell
    documents apart.
    """
    whole, early, everyone = chunks, chunks, chunks
    if isinstance(chunks, Windows):
        doc = chunks.doc
        whole, early, everyone = chunks.chunks(index, content), chunks.chunks(index, content, PHRASE_SKIP + PHRASE_CHUNKS), chunks.documents()
    everyone = everyone.select(F.col(doc)).distinct()
    done, take, found = 0, 4 * n, []
    while True:
        drawn = everyone.orderBy(order).offset(done).limit(take - done)
        small = take * PHRASES_TRIED <= BROADCAST_QUERIES
        if small:  # identifiers reach the scan as a condition
            ids = drawn.toArrow().column(0).to_pylist()
            last, own = len(ids) < take - done, early.where(F.col(doc).isin([x for x in ids if x is not None]))
        else:
            drawn = kept(drawn)
            last, own = drawn.count() < take - done, early.join(drawn, doc, "left_semi")
        asked = kept(phrase_asked(own, doc, index, content, analyzer))
        queries = asked.select("query").distinct()
        matches = phrase_documents(chunks, queries, doc, content, analyzer) if small else conjunctions(whole, queries, doc, index, content, analyzer)
        chosen = first_by_document(gated(asked, matches)).withColumn(doc, F.col("gold")).orderBy(order).limit(n - sum(map(len, found))).drop(doc)
        found.append(chosen.toArrow())  # n rows at most
        if sum(map(len, found)) >= n or last:
            return everyone.sparkSession.createDataFrame(pa.concat_tables(found), chosen.schema)
        done, take = take, 4 * take
