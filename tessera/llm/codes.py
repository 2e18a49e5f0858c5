"""Vector codes: a codebook for each part of the vectors, fitted over all of them by metric trees.

Vectors are cut into parts, and blocks of them get one tree a part, built middle
out: about the square root of the points become anchors, each new one the point
that is farthest from its anchor, taking the points that are nearer to it; each
anchor's points are split likewise, and anchors are merged upwards, the closest
first. A ball holds its points' number, sum, centre and radius. A round goes down
the trees. A ball inherits its parent's list of candidate entries and drops those
that are farther than its best one from each of its points; once one is left the
ball is wholly owned, and its number and sum are added at once. Only what reaches
a leaf is compared point by point. All is whole numbers, so results don't depend
on blocks or trees.

The trees are written once; a round reads them, and only sums by entry meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, group_facts, read_table, staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block, which has one tree a part, and points of a leaf.
BLOCK, LEAF = 4096, 16
#: Components beyond this would not fit whole-number distances; they are an error.
LARGEST = 1 << 27


def _anchors(x: np.ndarray) -> np.ndarray:
    """Which of about sqrt(n) anchors each point belongs to; points that are all equal have one."""
    wanted = int(np.ceil(np.sqrt(len(x))))
    owner, far = np.zeros(len(x), np.int64), ((x - x[0]) ** 2).sum(1)
    pivots = [0]
    while len(pivots) < wanted:
        new = int(far.argmax())
        if far[new] == 0:
            break
        # a point can only be nearer to the new anchor if it is half as far from its own as the anchors are from each other
        apart = ((x[pivots] - x[new]) ** 2).sum(1)
        may = np.flatnonzero(4 * far > apart[owner])
        d = ((x[may] - x[new]) ** 2).sum(1)
        won = d < far[may]
        owner[may[won]], far[may[won]] = len(pivots), d[won]
        pivots.append(new)
    return owner


class Tree:
    """Balls over the points of one part of a block, in the order ``order``.

    Of each ball: first and last place (``a``, ``b``), two children (-1: a leaf), centre, radius, sum. The last ball is the root.
    """

    FIELDS = ("order", "a", "b", "left", "right", "centre", "radius", "total")

    def __init__(self, x: np.ndarray):
        self.x, self.balls, self.order = x, [], np.empty(len(x), np.int64)
        self._build(np.arange(len(x)), 0)
        pick = lambda k: np.array([n[k] for n in self.balls])
        self.a, self.b, self.left, self.right, self.centre, self.radius, self.total = map(pick, range(7))

    def _ball(self, rows: np.ndarray, at: int, left: int = -1, right: int = -1) -> int:
        x = self.x[rows]
        total = x.sum(0)
        centre = total / len(rows)
        self.balls.append((at, at + len(rows), left, right, centre, float(np.sqrt(((x - centre) ** 2).sum(1).max())), total))
        return len(self.balls) - 1

    def _build(self, rows: np.ndarray, at: int) -> int:
        """The ball of ``rows``, which take the places from ``at`` on."""
        owner = _anchors(self.x[rows]) if len(rows) > LEAF else np.zeros(len(rows), np.int64)
        if not owner.any():
            self.order[at:at + len(rows)] = rows
            return self._ball(rows, at)
        groups = [rows[owner == k] for k in range(owner.max() + 1)]
        return self._merge([g for g in groups if len(g)], at)

    def _merge(self, groups: list[np.ndarray], at: int) -> int:
        """Merge the anchors' sets pairwise, those first that give the smallest ball; then place them from the root down."""
        k = len(groups)
        centre = np.array([self.x[g].mean(0) for g in groups])
        size = np.array([np.sqrt(((self.x[g] - c) ** 2).sum(1).max()) for g, c in zip(groups, centre)])
        n, kids, name = np.array([len(g) for g in groups], float), {}, list(range(k))
        about = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2)) + size[:, None] + size[None]
        np.fill_diagonal(about, np.inf)
        for new in range(k, 2 * k - 1):
            i, j = divmod(int(about.argmin()), k)
            kids[new] = (name[i], name[j])
            together = (centre[i] * n[i] + centre[j] * n[j]) / (n[i] + n[j])
            size[i] = max(np.linalg.norm(together - centre[i]) + size[i], np.linalg.norm(together - centre[j]) + size[j])
            centre[i], n[i], name[i] = together, n[i] + n[j], new
            about[j], about[:, j] = np.inf, np.inf
            alive = np.flatnonzero(np.isfinite(about[i]))
            about[i, alive] = about[alive, i] = np.sqrt(((centre[alive] - together) ** 2).sum(1)) + size[i] + size[alive]

        # without recursion: merges may be as deep as there are anchors
        sequence, todo = [], [2 * k - 2]
        while todo:  # parents before children, the left side's places first
            sequence.append(todo.pop())
            if sequence[-1] in kids:
                todo += reversed(kids[sequence[-1]])
        place = {}
        for q in sequence:
            if q < k:
                place[q], at = at, at + len(groups[q])
        made, rows = {}, {}
        for q in reversed(sequence):
            if q < k:
                made[q], rows[q] = self._build(groups[q], place[q]), groups[q]
            else:
                p, r = kids[q]
                rows[q], place[q] = np.concatenate([rows.pop(p), rows.pop(r)]), place[p]
                made[q] = self._ball(rows[q], place[q], made[p], made[r])
        return made[2 * k - 2]

    def fields(self) -> list[bytes]:
        kinds = dict.fromkeys(self.FIELDS, "<i4") | {"centre": "<f8", "radius": "<f8", "total": "<i8"}
        return [np.asarray(getattr(self, f)).astype(kinds[f]).tobytes() for f in self.FIELDS]

    @classmethod
    def read(cls, x: np.ndarray, fields: list[bytes]) -> Tree:
        self = cls.__new__(cls)
        width = x.shape[1]
        for f, raw in zip(cls.FIELDS, fields):
            v = np.frombuffer(raw, {"centre": "<f8", "radius": "<f8", "total": "<i8"}.get(f, "<i4"))
            setattr(self, f, v.reshape(-1, width) if f in ("centre", "total") else v)
        self.x = x[self.order]
        return self

    def owned(self, book: np.ndarray):
        """Yields (balls, entry of each) that are wholly owned, and at last (places, entry of each) of single points, as "balls" and "points"."""
        # an entry equal to an earlier one wins nowhere
        entries = np.sort(np.unique(book, axis=0, return_index=True)[1])
        apart = np.sqrt(((book[:, None] - book[None]).astype(float) ** 2).sum(2))
        ball = np.full(len(entries), len(self.a) - 1)
        entry, singles = entries, []
        while len(ball):
            first = np.flatnonzero(np.r_[True, ball[1:] != ball[:-1]])
            d = np.empty(len(ball))
            for s in range(0, len(ball), 1 << 16):
                part = slice(s, s + (1 << 16))
                d[part] = ((self.centre[ball[part]] - book[entry[part]]) ** 2).sum(1)
            count = np.diff(np.r_[first, len(ball)])
            least = np.repeat(np.minimum.reduceat(d, first), count)
            hit = np.flatnonzero(d == least)
            best = np.repeat(entry[hit[np.searchsorted(hit, first)]], count)
            # over the ball, the squares' difference is least 2 * radius * (distance of the entries) below that at its centre
            gap = d - least - 2 * self.radius[ball] * apart[best, entry]
            keep = (entry == best) | (gap <= 1e-6 * (1 + d))
            ball, entry = ball[keep], entry[keep]
            first = np.flatnonzero(np.r_[True, ball[1:] != ball[:-1]])
            count = np.repeat(np.diff(np.r_[first, len(ball)]), np.diff(np.r_[first, len(ball)]))
            alone = count == 1
            if alone.any():
                yield "balls", ball[alone], entry[alone]
            leaf = ~alone & (self.left[ball] < 0)
            if leaf.any():
                singles.append((ball[leaf], entry[leaf]))
            on = ~alone & ~leaf
            ball, entry = np.concatenate([self.left[ball[on]], self.right[ball[on]]]), np.tile(entry[on], 2)
            # a left child may be numbered as another's right one never is, so equal numbers still stand together
        for ball, entry in singles:
            first = np.flatnonzero(np.r_[True, ball[1:] != ball[:-1]])
            for s, e in zip(first.tolist(), [*first[1:].tolist(), len(ball)]):
                a, b, c = int(self.a[ball[s]]), int(self.b[ball[s]]), entry[s:e]
                d = ((self.x[a:b, None] - book[None, c]) ** 2).sum(2)
                yield "points", np.arange(a, b), c[d.argmin(1)]

    def sums(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, sum) of the points of each entry."""
        n, total = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
        for kind, at, entry in self.owned(book):
            np.add.at(n, entry, self.b[at] - self.a[at] if kind == "balls" else 1)
            np.add.at(total, entry, self.total[at] if kind == "balls" else self.x[at])
        return n, total

    def assigned(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each point, in the block's own order."""
        found = np.empty(len(self.order), np.int64)
        for kind, at, entry in self.owned(book):
            if kind == "balls":
                for a, b, c in zip(self.a[at].tolist(), self.b[at].tolist(), entry.tolist()):
                    found[a:b] = c
            else:
                found[at] = entry
        back = np.empty(len(found), np.int64)
        back[self.order] = np.arange(len(found))
        return found[back], ((self.x - book[found]) ** 2).sum(1)[back]


def whole(vectors: DataFrame, column: str) -> DataFrame:
    """Rows (vec_id, label, v) whose vector is whole: no null, no null or non-finite component; v is floor(SCALE * x)."""
    x = F.col(column)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    kept = vectors.filter(x.isNotNull() & fine & (F.size(x) > 0)).select("vec_id", label, x.alias("x"))
    scaled = lambda v: F.floor(v.cast("double") * SCALE)
    bounded = F.forall("x", lambda v: F.abs(v.cast("double") * SCALE) < LARGEST)
    large = F.raise_error(F.lit(f"a component is {LARGEST // SCALE} or more")).cast("array<long>")
    return kept.select("vec_id", "label", F.when(bounded, F.transform("x", scaled)).otherwise(large).alias("v"))


def _trees(width: int):
    """Blocks (ids and labels in order, vectors) with the trees of their parts."""
    def run(batches):
        held, n = [], 0

        def made(table: pa.Table):
            rows = table.num_rows
            v = table.column("v").combine_chunks()
            if len(v.values) != rows * width or (np.diff(v.offsets.to_numpy()) != width).any():
                raise ValueError("vectors differ in length")
            x = v.values.to_numpy(zero_copy_only=False)[v.offsets[0].as_py():][:rows * width].reshape(rows, width)
            step = width // PARTS
            trees = [Tree(np.ascontiguousarray(x[:, p * step:(p + 1) * step])).fields() for p in range(PARTS)]
            lists = [pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), table.column(c).combine_chunks()) for c in ("vec_id", "label")]
            fields = [pa.array([[t[i] for t in trees]], pa.list_(pa.binary())) for i in range(len(Tree.FIELDS))]
            return pa.RecordBatch.from_arrays([*lists, pa.array([x.astype("<i4").tobytes()], pa.binary()), *fields], ["vec_id", "label", "v", *Tree.FIELDS])

        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= BLOCK:
                table = pa.Table.from_batches(held)
                yield made(table.slice(0, BLOCK))
                held, n = table.slice(BLOCK).to_batches(), n - BLOCK
        if n:
            yield made(pa.Table.from_batches(held))

    return run


def _read(b: pa.RecordBatch, row: int, width: int) -> list[Tree]:
    x = np.frombuffer(b.column("v")[row].as_py(), "<i4").astype(np.int64).reshape(-1, width)
    step, fields = width // PARTS, [b.column(f)[row].as_py() for f in Tree.FIELDS]
    return [Tree.read(x[:, p * step:(p + 1) * step], [f[p] for f in fields]) for p in range(PARTS)]


def fitted(blocks: DataFrame, books: np.ndarray, width: int, rounds: int) -> np.ndarray:
    """Codebooks (PARTS, entries, width of a part) after ``rounds`` rounds. What comes to the driver is a sum an entry."""
    spark = blocks.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)  # entries times width numbers

        def sums(batches, shared=shared):
            n = total = 0
            for b in batches:
                for row in range(b.num_rows):
                    each = [t.sums(book) for t, book in zip(_read(b, row, width), shared.value)]
                    n, total = n + np.array([e[0] for e in each]), total + np.array([e[1] for e in each])
            if not np.isscalar(n):
                used = np.argwhere(n > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used[:, 0]), pa.array(used[:, 1]), pa.array(n[n > 0]), pa.array(list(total[n > 0]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

        found = blocks.select("v", *Tree.FIELDS).mapInArrow(sums, "part long, entry long, n long, total array<long>")
        step = width // PARTS
        merged = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(step)])
        books = books.copy()
        for r in merged.collect():  # PARTS * ENTRIES rows at most
            books[r.part, r.entry] = [r[f"t{i}"] // r.n for i in range(step)]
    return books


def compress(vectors: DataFrame, column: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(rows (vec_id, label, code, error, label_error), codebooks) of ``vectors`` (vec_id, label, and an array ``column``).

    Rows whose vector is null or empty, or holds null or non-finite components,
    are left out. Components become floor(1024 * x); ones of 131,072 or more, and
    vectors that differ in length or have no four equal parts, are errors. The
    codebooks start as the parts of the ``entries`` smallest vec_ids (rows that
    repeat one come by their components, a null id last); fewer rows give fewer
    entries. Ties go to the lower entry. ``label_error`` is the sum over equal
    labels, nulls together; no column ``label`` counts as nulls. Other columns do
    not pass. An empty table gives none, and codebooks without entries.
    """
    rows = staged(whole(vectors, column), "vectors")
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # a codebook
    kinds = ", ".join(f"{c} {'array<' if c != 'code' and c != 'error' else ''}{t}{'>' if c != 'code' and c != 'error' else ''}" for c, t in rows.select("vec_id", "label").dtypes)
    plain = ", ".join(f"{c} {t}" for c, t in rows.select("vec_id", "label").dtypes)
    if not start:
        return rows.select("vec_id", "label", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")]), np.zeros((PARTS, 0, 0), np.int64)
    width = len(start[0].v)
    if width % PARTS or any(len(r.v) != width for r in start):
        raise ValueError(f"vectors need one length, a multiple of {PARTS}")
    first = np.array([r.v for r in start], np.int64).reshape(len(start), PARTS, -1).transpose(1, 0, 2)
    binaries = ", ".join(f"{f} array<binary>" for f in Tree.FIELDS)
    blocks = staged(rows.mapInArrow(_trees(width), f"{kinds}, v binary, {binaries}"), "trees")
    books = fitted(blocks, first, width, rounds)
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def codes(batches):
        for b in batches:
            for row in range(b.num_rows):
                each = [t.assigned(book) for t, book in zip(_read(b, row, width), shared.value)]
                code = np.stack([e[0] for e in each], 1).astype(np.uint8)
                text = code.tobytes().hex()
                names = pa.array([text[i:i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)])
                yield pa.RecordBatch.from_arrays([b.column("vec_id")[row].values, b.column("label")[row].values, names, pa.array(sum(e[1] for e in each))], ["vec_id", "label", "code", "error"])

    coded = staged(blocks.mapInArrow(codes, f"{plain}, code string, error long"), "codes")
    # a label may be that of most rows, or missing: a name of its own stands for it, and rows are told apart by their number
    named = coded.withColumn("__label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))).withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(32)).cast("int"))
    facts = group_facts(named, "__label", "__salt", [F.sum("error").alias("label_error")])
    return attach(named, facts, "__label", "__salt").select("vec_id", "label", "code", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    done, books = compress(read_table(spark, sf_dir, "embeddings"))
    return done.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Rounds as a chain of tables: the assignment by |x|^2 - 2xc + |c|^2, exact in doubles for these components."""
    step = """
near{i} AS MATERIALIZED (SELECT p.row, p.part, p.x, min({{'d': p.xx - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x), 'e': c.entry}}) AS m
  FROM parts p JOIN book{i} c ON p.part = c.part GROUP BY ALL)"""
    move = """,
sums{i} AS (SELECT part, m.e AS entry, unnest(range(len(x))) AS k, unnest(x) AS v FROM near{i}),
mean{i} AS (SELECT part, entry, k, floor(sum(v) / count(*)) AS v FROM sums{i} GROUP BY ALL),
book{j} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM book{i} b
  LEFT JOIN (SELECT part, entry, list(v ORDER BY k) AS x FROM mean{i} GROUP BY ALL) n ON n.part = b.part AND n.entry = b.entry),"""
    out = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row, vec_id, label, list_transform(embedding, lambda v: floor(v::DOUBLE * {SCALE})) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(embedding) > 0),
cut AS (SELECT row, unnest(range({PARTS})) AS part, v FROM kept),
parts AS MATERIALIZED (SELECT row, part, x, list_inner_product(x, x) AS xx FROM (SELECT row, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS x FROM cut)),
book0 AS MATERIALIZED (SELECT part, row AS entry, x FROM parts WHERE row < {ENTRIES}),"""
    for i in range(ROUNDS + 1):
        out += step.format(i=i) + (move.format(i=i, j=i + 1) if i < ROUNDS else "")
    return out + f""",
digest AS (SELECT sha256(string_agg(x.v::BIGINT::VARCHAR, ',' ORDER BY x.part, x.entry, x.k)) AS s FROM (SELECT part, entry, unnest(range(len(x))) AS k, unnest(x) AS v FROM book{ROUNDS}) x),
coded AS (SELECT row, string_agg(lower(printf('%02x', m.e)), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM coded JOIN kept USING (row), digest"""


OP13_SQL = _sql()
