"""Spelling variant grouping: dense prefix-suffix tiling.

Two words are one edit apart exactly if their common prefix and suffix together reach the longer length minus one. Words
that are meet in blocks: a word of length B is cut into windows, and the one edit lies in one of them, so both words agree
on all that stands outside of it. A block has the words of length B and B + 1 with one window and one outside; what stands
inside the window is a row of a padded matrix of code points, and blocks are compared as whole tiles, rows of length B
against all. A pair counts in the window that holds the end of its common prefix, so it counts once.

A window takes three characters (a sixteenth of long words). Blocks of more rows than a bound are cut again into windows a
quarter as wide, down to one character, where a block is bounded by the alphabet. No pair leaves a task: each word of a
block gets its count and its best form there.

Edge cases: null texts have no words; texts are read whole; repeated rows count as often as they stand; a null doc_id counts
as empty text; equal counts go to the smallest form in code-point order; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import materialize, release

#: Letters of a word (fixed values); shortest word and fewest occurrences; how much more frequent a form is.
RUN, MIN_LENGTH, MIN_COUNT, RATIO = "[A-Za-z\\u00C0-\\u00FF]", 7, 2, 10
#: Characters of a window and windows of a long word; rows of a block that is cut again; rows that a task compares at once; rows and columns of a tile, and cells of tiles at once.
WINDOW, WINDOWS, CROWD, ROWS, TILE, CELLS = 3, 16, 4096, 1 << 16, 64, 1 << 20
BLOCK = ["base", "start", "stop", "outside"]
PAD_ROW, PAD_COLUMN = 0x110000, 0x110001


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the distinct words of all texts, as op12's contract makes them from runs of letters."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({RUN}{{{MIN_LENGTH},}})"), 1)).alias("run"))
    runs = runs.withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    h, size = F.crc32(F.concat_ws(":", "i", "run").cast("binary")), F.length("run")
    cut = F.concat(F.expr("substring(run, 1, cast(h % length(run) as int))"), F.expr("substring(run, cast(h % length(run) as int) + 2)"))
    words = runs.withColumn("h", h).where((size > MIN_LENGTH) | (F.col("h") % 31 != 0)).select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def windows(words: DataFrame) -> DataFrame:
    """Every word in its own windows and, as the longer word of a pair, in those of the length below."""
    roles = F.expr(f"filter(array(0, 1), x -> length(word) - x >= {MIN_LENGTH})")
    role = words.select("word", "n", F.explode(roles).alias("longer")).withColumn("base", F.length("word") - F.col("longer")).withColumn("wide", F.greatest(F.lit(WINDOW), F.ceil(F.col("base") / WINDOWS).cast("int")))
    return cut(role.withColumn("start", F.explode(F.expr("sequence(0, base - 1, wide)"))).withColumn("stop", F.least("base", F.col("start") + F.col("wide"))))


def cut(rows: DataFrame) -> DataFrame:
    outside = F.expr("concat(substring(word, 1, start), substring(word, stop + longer + 1))").alias("outside")
    return rows.select("base", "start", "stop", outside, "longer", F.expr("substring(word, start + 1, stop - start + longer)").alias("inside"), "n")


def narrower(rows: DataFrame) -> DataFrame:
    """The rows of crowded blocks in windows a quarter as wide."""
    whole = rows.withColumn("word", F.expr("concat(substring(outside, 1, start), inside, substring(outside, start + 1))")).withColumn("wide", F.expr("cast(ceil((stop - start) / 4) as int)"))
    return cut(whole.withColumn("end", F.col("stop")).withColumn("start", F.explode(F.expr("sequence(start, stop - 1, wide)"))).withColumn("stop", F.least("end", F.col("start") + F.col("wide"))))


def matrix(lengths: np.ndarray, codes: np.ndarray, pad: int, right: bool) -> np.ndarray:
    """Code points of strings as rows, padded at the other end."""
    wide = int(lengths.max(initial=0))
    out = np.full((len(lengths), wide), pad, np.uint32)
    place = np.arange(wide) + ((lengths - wide) if right else np.zeros_like(lengths))[:, None]
    out[(place >= 0) & (place < lengths[:, None])] = codes
    return out


def tiles(sizes: np.ndarray, own: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int, int, int]]]:
    """(first row, rows, first column, columns) of all tiles, by padded shape."""
    found: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    for a, b, at in zip(own.tolist(), sizes.tolist(), first.tolist(), strict=True):
        for i in range(0, a, TILE):
            for j in range(0, b, TILE):
                x, y = min(TILE, a - i), min(TILE, b - j)
                found.setdefault((1 << (x - 1).bit_length(), 1 << (y - 1).bit_length()), []).append((at + i, x, at + j, y))
    return found


def near_in(block: np.ndarray, longer: np.ndarray, last: np.ndarray, inside: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) of near words, rows of length B: block numbers ascend, in a block the rows come before longer words.

    last: whether the block's window is the last of its words.
    """
    lengths = np.array(list(map(len, inside)), np.int64)
    codes = np.frombuffer("".join(inside).encode("utf-32-le"), np.uint32)
    x_left, x_right = matrix(lengths, codes, PAD_ROW, False), matrix(lengths, codes, PAD_ROW, True)
    y_left, y_right = matrix(lengths, codes, PAD_COLUMN, False), matrix(lengths, codes, PAD_COLUMN, True)
    first = np.flatnonzero(np.diff(block, prepend=-1))
    sizes, own = np.diff(np.append(first, len(block))), np.add.reduceat(~longer, first)
    use = (own > 0) & (sizes > 1)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for (high, broad), some in tiles(sizes[use], own[use], first[use]).items():
        step = max(1, CELLS // (high * broad))
        for k in range(0, len(some), step):
            i, x, j, y = np.array(some[k : k + step]).T[:, :, None]
            rows, columns = i + np.minimum(np.arange(high), x - 1), j + np.minimum(np.arange(broad), y - 1)
            valid = (np.arange(high) < x)[:, :, None] & (np.arange(broad) < y)[:, None, :]
            shared = []
            for left, right, order in ((x_left, y_left, range(x_left.shape[1])), (x_right, y_right, range(x_left.shape[1] - 1, -1, -1))):
                a, b = left[rows], right[columns]
                run, total = valid.copy(), np.zeros(valid.shape, np.int32)
                for c in order:
                    run &= a[:, :, None, c] == b[:, None, :, c]
                    total += run
                    if not run.any():
                        break
                shared.append(total)
            size, long = lengths[rows], longer[columns]
            # the end of the common prefix belongs to a later window, or the pair is a row with itself
            here = (shared[0] < size[:, :, None]) | (last[rows][:, :, None] & long[:, None, :])
            near = valid & here & (shared[0] + shared[1] >= np.maximum(size[:, :, None], lengths[columns][:, None, :]) - 1)
            t, r, c = np.nonzero(near)
            out.append((rows[t, r], columns[t, c]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def compared(rows: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) of the words with a near word in a block; the form only if it is frequent enough."""
    target = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])

    def done(table: pa.Table, block: np.ndarray) -> pa.RecordBatch | None:
        n, start = table["n"].to_numpy(), table["start"].to_numpy()
        longer, inside = table["longer"].to_numpy() > 0, table["inside"].to_pylist()
        a, b = near_in(block, longer, (table["stop"].to_numpy() == table["base"].to_numpy()), inside)
        if not len(a):
            return None
        # a row meets the words of its length both ways round, longer words once
        once = longer[b]
        a, b = np.concatenate([a, b[once]]), np.concatenate([b, a[once]])
        outside = table["outside"]

        def word(i: int) -> str:
            rest, at = outside[i].as_py(), int(start[i])
            return rest[:at] + inside[i] + rest[at:]

        best: dict[int, tuple[int, str]] = {}
        fit = n[b] >= RATIO * n[a]
        for i, j in zip(a[fit].tolist(), b[fit].tolist(), strict=True):
            found = (-int(n[j]), word(j))
            if i not in best or found < best[i]:
                best[i] = found
        which, counts = np.unique(a, return_counts=True)
        forms = [best.get(i) for i in which.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([word(i) for i in which.tolist()]), pa.array(counts), pa.array([f and -f[0] for f in forms], pa.int64()), pa.array([f and f[1] for f in forms], pa.string())], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting, limit = 0, ROWS

        def ready(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting, limit
            table = pa.Table.from_batches(held).combine_chunks()
            new = np.zeros(len(table), bool)
            for name in BLOCK:
                new[1:] |= pc.not_equal(table[name].slice(1), table[name].slice(0, len(table) - 1)).to_numpy()
            block = np.cumsum(new)
            whole = len(table) if final else int(np.searchsorted(block, block[-1]))  # the last block may go on
            if whole and (out := done(table.slice(0, whole), block[:whole])) is not None:
                yield out
            held = table.slice(whole).to_batches()
            waiting = len(table) - whole
            limit = max(ROWS, 2 * waiting)

        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting >= limit:
                yield from ready(False)
        if waiting:
            yield from ready(True)

    return rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "longer").mapInArrow(run, "word string, n_near long, form_n long, form string")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words (word, n) that have a near word."""
    rows, found = windows(words), None
    while True:
        crowded = materialize(rows.groupBy(*BLOCK).count().where((F.col("count") > CROWD) & (F.col("stop") - F.col("start") > 1)).select(*BLOCK), "crowded")
        some = not crowded.isEmpty()
        part = compared(rows.join(crowded, BLOCK, "left_anti") if some else rows)
        found = part if found is None else found.unionByName(part)
        if not some:
            break
        rows = materialize(narrower(rows.join(crowded, BLOCK)), "narrower")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.form", (-F.col("b.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, twice as far each round. Counts grow tenfold a step, so few rounds do."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(now)
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts."""
    words = materialize(vocabulary(docs, id_col, text_col), "words")
    near = materialize(near_words(words), "near-words")
    last = roots(near.where("form is not null"))
    out = words.join(near, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
