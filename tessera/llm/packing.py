"""Cost-balanced packing of token ids into sequences of one capacity.

A training step waits for its dearest sequence, so sequences should cost alike,
not only hold as many tokens. A piece of n tokens costs n * (6 * width + n): the
matrix products grow with the tokens, attention with their square. Pieces are
dealt by hash into groups of about GROUP; in a group they come by descending
length, and each goes to the sequence of lowest cost that has room for it. Where
none has, the roomiest takes what it can hold. A group's sequences hold just its
tokens: as many full ones as there are, and the rest in powers of two, so nothing
is padded.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, partitions, read_table, slices, staged

END, CAPACITY, WIDTH = 1, 2048, 1024
#: Pieces of a group on average; a group is packed at once.
GROUP = 1024
#: Encoded words that a Python worker remembers, in each of two generations, and half as many pre-tokens.
MEMO = 600_000
#: Code points below this are cut by the pattern here if it cuts them as the tokenizer does; texts with others go through the tokenizer.
KNOWN = 0x3000
#: Between pre-tokens on their way to the model; no byte of theirs maps to it.
_GAP = "Ȁ"
#: What makes a text of the first 256 code points uneven: spaces that meet, and spaces of other kinds at all.
_UNEVEN = ("  ", "\n ", " \n", "\n\n\n", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0")
_held: dict[str, ByteEncoder] = {}


def _latin(text: str) -> bool:
    """Are all code points among the first 256?"""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class ByteEncoder:
    """Ids of whole texts by a byte-level tokenizer: texts are cut as it cuts them, and each pre-token is encoded once.

    A space before a word always begins a pre-token, and a line end between words, or one of two, is one. So a text
    is split at both, and a word's ids are remembered with the space or line end before it; a text where spaces meet
    otherwise is cut by the pattern. A text with a special token's name, or with a code point that the pattern may
    class otherwise, goes through the tokenizer whole.
    """

    #: Fixed value: how the byte-level pre-tokenizer cuts a text.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import re

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cut = regex.compile(self.PATTERN).findall
        self.memo, self.words = Memo(self._encoded, MEMO // 2), Memo(self._words, MEMO)
        self.meet = re.compile(r"\s[^\S\n]|[^\S\n]\n|\n\n\n|\s\Z").search
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        #: Does the tokenizer cut as PATTERN does, and leave texts as they are?
        self.plain = pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and spec["normalizer"] is None and spec["model"]["type"] == "BPE"
        special = [t["content"] for t in spec["added_tokens"]]
        whole = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.plain else None
        letter = {chr(c) for c in range(KNOWN)} if self.plain else set()
        # beside a letter, a digit and a mark, a code point joins the one of its class, and none if it is a space
        for c in sorted(letter):
            if any([t[1] for t in whole(f"{x}{c}{x}")] != self._spans(f"{x}{c}{x}") for x in "a1!"):
                letter.discard(c)
        runs = []
        for c in sorted(map(ord, letter)):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        self.special = special
        #: Are all of the first 256 code points cut alike?
        self.low = set(map(chr, range(256))) <= letter
        self.strange = re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]").search if runs else None
        # the byte-level alphabet: printable Latin-1 stands for itself, the rest for 256 and on
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)} | {ord(_GAP): " "}
        self.space = self.alphabet[32]
        vocab = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t.startswith(self.space)]] = True
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    @staticmethod
    def of(path: str) -> ByteEncoder:
        if path not in _held:
            _held[path] = ByteEncoder(path)
        return _held[path]

    def _spans(self, text: str) -> list[tuple[int, int]]:
        ends = np.cumsum([0, *map(len, self.cut(text))]).tolist()
        return list(zip(ends, ends[1:]))

    def _encoded(self, found: list[str]) -> list[bytes]:
        """Ids of pre-tokens, by the model alone."""
        out = []
        for a in range(0, len(found), 4_000):
            out += self._mapped(_GAP.join([t.encode().decode("latin-1") for t in found[a:a + 4_000]]).translate(self.alphabet))
        return out

    def _mapped(self, text: str) -> list[bytes]:
        """Ids of pre-tokens that are in the byte-level alphabet already, with spaces between them."""
        one = self.bare.encode(text, add_special_tokens=False)  # the fast call knows no word ids
        at = np.array(one.word_ids)
        return self._parted(one.ids, np.flatnonzero(at[1:] != at[:-1]) + 1)

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain letters, each with a space before it: the one token that begins with a space begins a word."""
        ids = self.bare.encode_batch_fast([self.space + f" {self.space}".join(words)], add_special_tokens=False)[0].ids
        return self._parted(ids, np.flatnonzero(self.begins[ids])[1:])

    def _parted(self, ids: list[int], ends: np.ndarray) -> list[bytes]:
        raw, w = np.array(ids, self.kind).tobytes(), self.kind.itemsize
        ends = [*(ends * w).tolist(), len(raw)]
        return [raw[x:y] for x, y in zip([0, *ends], ends)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with the space or line end before it, or none where it begins with NUL. Letters alone are one pre-token; the others are cut together."""
        out: list[bytes] = [b""] * len(words)
        alone, cut, lines = [], [], []
        for i, w in enumerate(words):
            (alone if w.isascii() and w.isalpha() else lines if w[:1] in ("\n", "\0") else cut).append(i)
        for a in range(0, len(alone), 4_000):
            part = alone[a:a + 4_000]
            for i, x in zip(part, self._spaced([words[i] for i in part])):
                out[i] = x
        if cut:
            found = self.cut("".join([f" {words[i]}\n" for i in cut]))
            held = self.memo.hold(set(found))
            parts, at = [], iter(cut)
            for t in found:
                if t == "\n":
                    out[next(at)] = b"".join(parts)
                    parts = []
                else:
                    parts.append(held[t])
        for i, found in zip(lines, self.memo.values([self.cut(words[i].removeprefix("\0")) for i in lines])):
            out[i] = b"".join(found)
        return out

    def odd(self, text: str) -> bool:
        """Must the tokenizer itself see the whole text?"""
        if not self.plain or any(s in text for s in self.special):
            return True
        return not (self.low and _latin(text)) and self.strange(text) is not None

    def uneven(self, text: str) -> bool:
        """Do spaces meet other than as two line ends, or end the text?"""
        if _latin(text):
            return text[-1:].isspace() or any(s in text for s in _UNEVEN)
        return self.meet(text) is not None

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, ``kind`` each."""
        out, whole, cut, split = [b""] * len(texts), [], [], []
        for i, t in enumerate(texts):
            if t:
                (whole if self.odd(t) else cut if "\0" in t or self.uneven(t) else split).append(i)
        # Arrow numbers the words, each different one is looked up once, and Arrow puts their ids in the words' places
        words = pc.split_pattern(pa.array(["\0" + texts[i].replace("\n", " \n") for i in split], pa.large_string()), " ")
        numbered = words.values.dictionary_encode()
        ids = pa.array(self.words.values([numbered.dictionary.to_pylist()])[0], pa.large_binary()).take(numbered.indices)
        if split:
            _, at, raw = ids.buffers()
            ends = np.frombuffer(at, np.int64)[words.offsets.to_numpy()].tolist()
            for i, x, y in zip(split, ends, ends[1:]):
                out[i] = raw[x:y].to_pybytes()
        for i, found in zip(cut, self.memo.values([self.cut(texts[i]) for i in cut])):
            out[i] = b"".join(found)
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False) if whole else ()):
            out[i] = np.array(e.ids, self.kind).tobytes()
        return out


def _pieces(path: str, capacity: int):
    """Rows (doc_id, doc_tokens, start, ids) of each document's pieces of ``capacity`` ids, the last one shorter."""
    def run(batches):
        made = ByteEncoder.of(path)
        step, end = capacity * made.kind.itemsize, np.array([END], made.kind).tobytes()
        for part in slices(batches):
            ids = [x + end for x in made.encode(["" if t is None else t for t in part.column(1).to_pylist()])]
            n = np.array([len(x) // made.kind.itemsize for x in ids], np.int64)
            k = -(-n // capacity)
            row = np.repeat(np.arange(len(ids)), k)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)) * capacity
            body = [ids[r][a * made.kind.itemsize:][:step] if len(ids[r]) > step else ids[r] for r, a in zip(row.tolist(), start.tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(n[row]), pa.array(start, pa.int64()), pa.array(body, pa.binary())], ["doc_id", "doc_tokens", "start", "ids"])

    return run


def balanced(lengths: list[int], capacity: int, width: int = WIDTH) -> list[tuple[int, int, int, int, int]]:
    """Rows (piece, start in it, length, sequence, offset) for pieces of descending length.

    Each goes to the sequence of lowest cost that has room for it, of equals the
    first; where none has, the roomiest takes what it can hold, and the rest goes on.
    """
    total = sum(lengths)
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if total % capacity >> b & 1]
    size = np.array(sizes, np.int64)
    room, cost, out = size.copy(), np.zeros(len(size), np.int64), []
    never = np.iinfo(np.int64).max
    for i, n in enumerate(lengths):
        at = 0
        while n:
            j = int(np.where(room >= n, cost, never).argmin())
            if room[j] < n:
                j = int(room.argmax())
            take = min(n, int(room[j]))
            out.append((i, at, take, j, int(size[j] - room[j])))
            room[j] -= take
            cost[j] += take * (6 * width + take)
            at, n = at + take, n - take
    return out


def _packed(groups: int, capacity: int, width: int, kind: np.dtype):
    """Packs each group; a partition's groups come in order."""
    def pack(held: pa.Table):
        ids = held.column("ids").to_pylist()
        n = np.array([len(x) // kind.itemsize for x in ids])
        order = np.lexsort((held.column("rid").to_numpy(), -n))
        done = np.array(balanced(n[order].tolist(), capacity, width), np.int64).reshape(-1, 5)
        at, (start, size) = order[done[:, 0]], done[:, 1:3].T
        body = [np.frombuffer(ids[i], kind)[a:a + m].astype("<u4").tobytes() for i, a, m in zip(at.tolist(), start.tolist(), size.tolist())]
        group = held.column("group")[0].as_py()
        take = held.select(["doc_id", "doc_tokens"]).take(pa.array(at)).combine_chunks()
        first = held.column("start").to_numpy()[at]
        return pa.RecordBatch.from_arrays(
            [take.column("doc_id").combine_chunks(), pa.array(first + start), pa.array(size), take.column("doc_tokens").combine_chunks(), pa.array(done[:, 3] * groups + group), pa.array(done[:, 4]), pa.array(body, pa.binary())],
            ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            g = b.column("group").to_numpy()
            ends = [*(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for a, e in zip([0, *ends], ends):
                part = b.slice(a, e - a)
                if held and held[0].column("group")[0] != part.column("group")[0]:
                    yield pack(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield pack(pa.Table.from_batches(held))

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, width: int = WIDTH) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of ``docs`` (doc_id, text) in sequences of ``capacity`` ids.

    A document's ids are those of the tokenizer in the file ``path``, then id 1;
    a null text is the empty one. ``start`` counts the document's ids before the
    piece, ``offset`` the sequence's; ``ids`` are little-endian unsigned 32-bit
    numbers. A sequence is full, or holds a power of two of ids. Rows that repeat
    a doc_id, or have none, are documents of their own; their pieces are told
    apart by sequence and offset alone. Other columns do not pass. An empty table
    gives none. ``capacity`` is a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity), f"doc_id {kind}, doc_tokens long, start long, ids binary")
    made = staged(made, "pieces")  # from here on row numbers stand
    spark = made.sparkSession
    groups = max(1, -(-made.count() // GROUP))
    dealt = made.withColumn("rid", F.monotonically_increasing_id()).withColumn("group", F.pmod(F.xxhash64("rid"), F.lit(groups)))
    dealt = dealt.repartition(partitions(spark), "group").sortWithinPartitions("group")
    done = dealt.mapInArrow(_packed(groups, capacity, width, ByteEncoder.of(path).kind), f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return done


def op12_cost_balanced_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 ids."""
    import public_tokenizers

    done = pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
