"""Content-addressed store of token ids.

A document's ids are cut where a rolling hash over them says so, so equal
passages give equal chunks wherever they stand. A chunk is named by the digest
of its bytes and stored once; a document is a recipe of names and lengths. The
recipes are filed in ascending doc_id order under a Merkle tree.

Files under the store's path::

    pack/kind=chunk    key (BLAKE2b-128 of body), body (ids, little-endian)
    index              rank, doc_id, start, n_tokens, recipe, leaf
    manifest           level, node, digest; the last level has one row
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, attach, group_facts, new_path, partitions, prefix, read_table, salt_of

END = 1
#: Chunk lengths in ids: a cut on average every 2**CUT_BITS ids, within these bounds.
CUT_BITS, LEAST, MOST = 8, 64, 1024
FANOUT = 256
#: Encoded words that a Python worker remembers, in each of two generations.
MEMO = 500_000
#: Rows that are encoded at once.
_SLICE = 2_000
#: deal: by what a row is dealt over the tasks; chunks by their key, recipes evenly, as one text may recur without end.
_COLUMNS = ["deal", "kind", "key", "doc_id", "n", "body"]
_held: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of texts by a tokenizer whose pre-tokens never cross ASCII white space.

    Encoding word by word then gives the ids of the whole text. A word of plain
    Latin letters, digits and symbols is cut where the tokenizer's own pattern
    cuts it, and its model encodes each run that the memo doesn't hold; any
    other word goes through the whole tokenizer.
    """

    #: Printable ASCII but the apostrophe (contractions), and the Latin-1 letters: NFC leaves them alone.
    PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
    LETTERS = re.compile("[a-zß-öø-ÿ]+")
    RUNS = re.compile("[a-zß-öø-ÿ]+|[0-9]|\n|[^a-zß-öø-ÿ0-9\n]+")
    LAST = "</w>"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words, self.runs = Memo(self._words, MEMO), Memo(self._runs, MEMO // 2)
        self.end = np.array([END], dtype=self.kind).tobytes()
        # the byte-level alphabet: printable Latin-1 stands for itself, the rest for 256 and on
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in seen and b != 32]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(sorted([*rest, 32])) if b != 32}
        spec = json.loads(self.tokenizer.to_str())
        #: Does the tokenizer cut and normalise as RUNS supposes?
        self.plain = (
            spec["model"].get("end_of_word_suffix") == self.LAST and spec["model"]["type"] == "BPE"
            and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        )
        normal = spec["normalizer"] or {}
        self.lowers = "Lowercase" in [normal.get("type"), *(n["type"] for n in normal.get("normalizers", []))]
        #: The same model on runs that are cut and mapped already.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith(self.LAST)]] = True

    @staticmethod
    def of(path: str) -> WordEncoder:
        if path not in _held:
            _held[path] = WordEncoder(path)
        return _held[path]

    def _runs(self, runs: list[str]) -> list[bytes]:
        """Ids of runs: each ends with the one token that bears the suffix."""
        plain = [r for r in runs if r.isascii()]
        if len(plain) < len(runs):
            rest = [r for r in runs if not r.isascii()]
            found = dict(zip(rest, self._mapped(" ".join(rest).encode().decode("latin-1").translate(self.alphabet).split(" "))))
            found.update(zip(plain, self._mapped(plain)))
            return [found[r] for r in runs]
        return self._mapped(runs)

    def _mapped(self, runs: list[str]) -> list[bytes]:
        """The same for runs in the byte-level alphabet, where printable ASCII stands for itself."""
        out = []
        for a in range(0, len(runs), 4_000):
            text = " ".join(runs[a:a + 4_000])
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)
            raw, w = ids.tobytes(), self.kind.itemsize
            ends = ((np.flatnonzero(self.last[ids]) + 1) * w).tolist()
            out += [raw[x:y] for x, y in zip([0, *ends], ends)]
        return out

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words; letters alone are a run, the other plain ones are cut. An empty word has none."""
        text = b"\n".join(words).decode().lower().split("\n")
        out: list[bytes | None] = [None] * len(text)
        alone, cut, rest = [], [], []
        letters, plain = self.LETTERS.fullmatch, self.PLAIN.fullmatch if self.plain else (lambda t: None)
        for i, t in enumerate(text):
            if not t:
                out[i] = b""
                continue
            (alone if letters(t) and self.plain else cut if plain(t) and "<|" not in t else rest).append(i)
        if alone:
            found = self._runs([text[i] for i in alone])
            for i, x in zip(alone, found):
                out[i] = x
            self.runs.now.update(zip([text[i] for i in alone], found))
        if cut:
            runs = self.RUNS.findall("\n".join([text[i] for i in cut]))
            held = self.runs.hold(set(runs) - {"\n"})
            parts, at = [], iter(cut)
            for r in runs:
                if r == "\n":
                    out[next(at)] = b"".join(parts)
                    parts = []
                else:
                    parts.append(held[r])
            out[next(at)] = b"".join(parts)
        if rest:
            for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i].decode() for i in rest], add_special_tokens=False)):
                out[i] = np.array(e.ids, dtype=self.kind).tobytes()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after the other, each with the end, and where each text ends.

        Arrow splits the texts and numbers their distinct words, so only those are looked up.
        """
        texts = pc.fill_null(texts, "")
        # A-Z are lower-cased here, but for texts that may name a special token: this encoder lower-cases
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)) if self.lowers else texts
        lists = pc.ascii_split_whitespace(texts)
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        # words hold no line break, so one split gives them all
        words = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), "\n")[0].as_py().encode().split(b"\n")[:len(coded.dictionary)]
        ids = [*self.words.values([words])[0], self.end]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        known, first = np.frombuffer(b"".join(ids), self.kind), np.cumsum(size) - size
        which = np.full(len(coded) + len(n), len(words))
        which[np.arange(len(coded)) + np.repeat(np.arange(len(n)), n)] = coded.indices.to_numpy()
        length = size[which]
        ends = np.cumsum(length)
        return known[np.repeat(first[which] - ends + length, length) + np.arange(int(length.sum()))], ends[np.cumsum(n + 1) - 1]


def _gear(ids: np.ndarray) -> np.ndarray:
    """Rolling hash of the last 32 ids at each place."""
    g = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    h = (g ^ (g >> np.uint32(15))) * np.uint32(2246822519)
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)  # the right side is computed before it is added
    return h


def cuts(hits: list[int], n: int) -> list[int]:
    """Ends of the chunks of ``n`` ids, given the places where the rolling hash says to cut; the last is n."""
    ends, at = [], 0
    for c in [*hits, n]:
        while c - at > MOST:
            at += MOST
            ends.append(at)
        if c - at >= LEAST or c == n and c > at:
            at = c
            ends.append(at)
    return ends


def _cut_all(ids: np.ndarray, ends: np.ndarray):
    """Chunk ends of each of several texts that lie in one array.

    The hash is taken over all at once: no chunk ends within the first LEAST ids
    of a text, and further on the hash's window lies inside the text.
    """
    hits = np.flatnonzero(_gear(ids) >> np.uint32(32 - CUT_BITS) == 0) + 1
    starts = np.r_[0, ends[:-1]]
    a, b = np.searchsorted(hits, starts, side="right"), np.searchsorted(hits, ends)
    hits = hits.tolist()
    for i, (x, y) in enumerate(zip(starts.tolist(), ends.tolist())):
        yield cuts([h - x for h in hits[a[i]:b[i]]], y - x)


def _pack(path: str):
    def run(batches):
        enc = WordEncoder.of(path)
        width, seen = enc.kind.itemsize, set()

        number = iter(range(TaskContext.get().partitionId() << 40, 1 << 62) if TaskContext.get() else range(1 << 62))
        for b in batches:
            for start in range(0, b.num_rows, _SLICE):
                part = b.slice(start, _SLICE)
                chunks, recipes = [], []
                every, ends = enc.encode(part.column(1))
                raw, x = every.tobytes(), 0
                for y, places in zip(ends.tolist(), _cut_all(every, ends)):
                    recipe, i = [], x
                    for place in places:
                        j = x + place
                        body = raw[i * width:j * width]
                        key = hashlib.blake2b(body, digest_size=16).digest()
                        recipe += (key, (j - i).to_bytes(2, "little"))
                        if key not in seen:
                            seen.add(key)
                            chunks.append((key, body))
                        i = j
                    recipes.append(b"".join(recipe))
                    x = y
                if len(seen) > 1_000_000:
                    seen.clear()  # only spares shuffle
                k, names = len(chunks), pa.array([c[0] for c in chunks], pa.binary())
                kind = part.column(0).type
                yield pa.RecordBatch.from_arrays([names, pa.array(["chunk"] * k), names, pa.nulls(k, kind), pa.nulls(k, pa.int64()), pa.array([c[1] for c in chunks], pa.binary())], _COLUMNS)
                digests = pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in recipes], pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.array([next(number).to_bytes(8, "little") for _ in recipes], pa.binary()), pa.array(["recipe"] * part.num_rows), digests, part.column(0),
                    pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(recipes, pa.binary())], _COLUMNS)

    return run


def _once(batches):
    """Drops chunks that this partition has seen; equal keys share a partition."""
    seen: set[bytes] = set()
    for b in batches:
        keep = []
        for kind, key in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            keep.append(kind == "recipe" or key not in seen)
            if kind == "chunk":
                seen.add(key)
        yield b.filter(pa.array(keep)).select(_COLUMNS[1:])


_ROW = "kind string, key binary, doc_id long, n long, body binary"


def _tree(leaves: DataFrame) -> list[tuple[int, DataFrame]]:
    """Levels (rank, digest) above the leaves, FANOUT children to a node."""
    spark, level, out = leaves.sparkSession, leaves, []
    n = leaves.count()
    while n > 1 or not out:
        nodes = level.groupBy(F.expr(f"rank div {FANOUT}").alias("node")).agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("c"))
        level = nodes.select(F.col("node").alias("rank"), F.sha2(F.concat_ws("", F.col("c.digest")), 256).alias("digest"))
        path = new_path(spark, "tree")
        level.write.parquet(path)
        level = spark.read.parquet(path)
        out.append((len(out) + 1, level))
        n = -(-n // FANOUT) if n else 0
        if n == 0:
            break
    return out


def _leaf():
    what = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "start", "n_tokens", F.hex("recipe"))
    return F.sha2(what, 256)


def write_store(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode ``docs`` (doc_id, text) with the tokenizer file and write the store.

    Rows with a null doc_id come first; rows that repeat a doc_id are filed by
    their content. A null text is the end alone. doc_id is stored as a long; a
    value that is none is an error. Other columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack(tokenizer), f"deal binary, {_ROW}")
    rows.repartition("deal").mapInArrow(_once, _ROW).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/pack")
    # an empty table leaves no folders to read kinds from
    recipes = _read_pack(spark, path).filter("kind = 'recipe'").select("doc_id", "key", F.col("n").alias("n_tokens"), F.col("body").alias("recipe"))
    ranked = prefix(recipes, ["doc_id", "key"], "n_tokens", "recipes")
    index = ranked.select(F.col("__rank").alias("rank"), "doc_id", F.col("__before").alias("start"), "n_tokens", "recipe").withColumn("leaf", _leaf())
    index.repartitionByRange(partitions(spark), "rank").sortWithinPartitions("rank").write.parquet(f"{path}/index")
    leaves = spark.read.parquet(f"{path}/index").select("rank", F.col("leaf").alias("digest"))
    for level, nodes in _tree(leaves):
        nodes.select(F.lit(level).alias("level"), F.col("rank").alias("node"), "digest").write.mode("append").parquet(f"{path}/manifest")


def _read_pack(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key binary, doc_id long, n long, body binary, kind string").parquet(f"{path}/pack")


def verify(spark: SparkSession, path: str) -> None:
    """Rebuild the tree from the index and compare every node with the manifest."""
    index = spark.read.parquet(f"{path}/index")
    bad = index.filter(_leaf() != F.col("leaf")).isEmpty()
    stored = spark.read.parquet(f"{path}/manifest")
    rebuilt = None
    for level, nodes in _tree(index.select("rank", _leaf().alias("digest"))):
        part = nodes.select(F.lit(level).alias("level"), F.col("rank").alias("node"), "digest")
        rebuilt = part if rebuilt is None else rebuilt.unionByName(part)
    if not bad or not stored.exceptAll(rebuilt).isEmpty() or not rebuilt.exceptAll(stored).isEmpty():
        raise ValueError(f"the store's index and its Merkle manifest differ: {path}")


def _crc_tables() -> np.ndarray:
    """[k, b]: what bit b of a CRC-32 becomes when 2**k zero bytes follow."""
    def times(m, v):
        out = 0
        for i in range(32):
            if v >> i & 1:
                out ^= m[i]
        return out

    m = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    for _ in range(3):
        m = [times(m, x) for x in m]
    tables = []
    for _ in range(48):
        tables.append(m)
        m = [times(m, x) for x in m]
    return np.array(tables, dtype=np.uint32)


def crc_shift(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRC-32 values as they count when ``zeros`` more bytes follow: XORed, they give the whole's."""
    tables, crc = _crc_tables(), crc.astype(np.uint32)
    for k in range(48):
        on = (zeros >> k) & 1 == 1
        if on.any():
            c, out = crc[on], np.zeros(int(on.sum()), np.uint32)
            for b in range(32):
                out ^= np.where((c >> np.uint32(b)) & np.uint32(1), tables[k, b], np.uint32(0))
            crc[on] = out
    return crc


def _facts(batches):
    """Each stored chunk's length, CRC over 32-bit ids, and whether its name is its digest."""
    for b in batches:
        keys, bodies, widths = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
        ids = [np.frombuffer(x, dtype=f"<u{w}") for x, w in zip(bodies, widths)]
        yield pa.RecordBatch.from_arrays([
            b.column(0), pa.array([len(i) for i in ids], pa.int32()),
            pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
            pa.array([hashlib.blake2b(x, digest_size=16).digest() == k for k, x in zip(keys, bodies)])], ["key", "n", "crc", "sound"])


def _links(batches):
    """The recipes' chunks: key, length, and the ids that follow in the document."""
    for b in batches:
        out = [[], [], [], []]
        for rank, recipe in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            e = np.frombuffer(recipe, dtype=np.dtype([("key", "V16"), ("n", "<u2")]))
            n = e["n"].astype(np.int64)
            out[0].append(np.full(len(e), rank))
            out[1] += [k.tobytes() for k in e["key"]]
            out[2].append(n)
            out[3].append(n.sum() - np.cumsum(n))
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out[0], out[2], out[3])]
        yield pa.RecordBatch.from_arrays([pa.array(flat[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(flat[1], pa.int64()), pa.array(flat[2], pa.int64())], ["rank", "key", "want", "after"])


def _width(tokenizer: str) -> int:
    return WordEncoder.of(tokenizer).kind.itemsize


def read_index(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files.

    Every stored chunk is hashed anew; a chunk that is missing or differs from
    its name, or a length that differs from the recipe, is an error.
    """

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(crc_shift(crc.to_numpy(np.int64), after.to_numpy(np.int64) * 4).astype(np.int64))

    chunks = _read_pack(spark, path).filter("kind = 'chunk'").select("key", "body", F.lit(width).alias("w"))
    facts = chunks.mapInArrow(_facts, "key binary, n int, crc long, sound boolean")
    index = spark.read.parquet(f"{path}/index")
    links = index.select("rank", "recipe").mapInArrow(_links, "rank long, key binary, want long, after long")
    # a chunk may recur in many documents, as that of the empty text does
    salted = links.withColumn("__salt", salt_of("rank"))
    joined = attach(salted, group_facts(salted, "key", "__salt", []).join(facts, "key", "left"), "key", "__salt")
    sound = F.col("sound") & (F.col("n") == F.col("want"))
    crc = F.when(sound, F.col("crc")).otherwise(F.raise_error(F.lit("a chunk is missing or damaged")).cast("long"))
    docs = joined.select("rank", "want", shifted(crc, "after").alias("c")).groupBy("rank").agg(F.bit_xor("c").alias("ids_crc32"), F.sum("want").alias("__n"))
    good = F.when(F.col("__n") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a recipe is damaged")).cast("long"))
    return index.join(docs, "rank", "left").select("doc_id", "start", good.alias("n_tokens"), "ids_crc32")


def read_ids(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, ids) of each document, put together from its chunks."""
    chunks = _read_pack(spark, path).filter("kind = 'chunk'").select("key", "body")
    index = spark.read.parquet(f"{path}/index")
    links = index.select("rank", "recipe").mapInArrow(_links, "rank long, key binary, want long, after long")
    salted = links.withColumn("__salt", salt_of("rank"))
    parts = attach(salted, group_facts(salted, "key", "__salt", []).join(chunks, "key"), "key", "__salt").groupBy("rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("after")).alias("o"), "body"))).alias("c"))

    @F.pandas_udf("array<int>")
    def ids(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda x: np.frombuffer(b"".join(x), dtype=f"<u{width}").astype(np.int32))

    return index.join(parts, "rank").select("doc_id", ids(F.col("c.body")).alias("ids"))


def op6_token_store(spark, sf_dir):
    import public_tokenizers

    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = new_path(spark, "store")
    write_store(read_table(spark, sf_dir, "documents"), path, tokenizer)
    verify(spark, path)
    return read_index(spark, path, _width(tokenizer))
