"""SentencePiece encoding and decoding with a relational lattice.

The text is normalised as the models here do it: a blank in front, blanks written as U+2581. No piece
crosses from another character to U+2581, so the text falls into words (a run of U+2581 and what
follows), and equal words have equal best segmentations. The lattice is built once per distinct word:
substrings of at most the longest piece are exploded, equi-joined to the piece table (whose size is
fixed by the model), grouped by the number of the word without another exchange, and folded to the segmentation of
highest total score with ``aggregate``: one fold over the edges in order of their ends to the best totals, one back from
the last character along the edges that give them. Ties go to the longer last piece. A character without a piece of its own costs the lowest
score less ten and becomes byte pieces.

Texts are packed into compressed blocks of bounded size, stored in buckets, and never shuffled. A block
sends its distinct words, sorted and joined per word part; the ids come back in the same order, without the
words. A word is segmented once per ``GROUP_BLOCKS`` blocks, so its list of blocks has a bound too.

Words of more than ``LONG_WORD`` characters (text without blanks) take a way of their own: overlapping chunks of
bounded length are exploded in parallel, edges are grouped per chunk, and the chunks of a word folded in order, so
the work grows with the length of the word. Texts that may hold such words are packed into blocks of their own.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import batch_of, release, slices
from lacuna.session import run_folder

DEFAULT_MODEL = "piece_bpe_32k.model"
SPACE = "▁"
_JOIN = "\x01"
_END = -(1 << 31)
#: Bytes of text in one block, at most (a longer text is a block of its own).
BLOCK_BYTES = 8 << 20
#: Distinct units between blanks that are cut into words by one search.
UNITS_AT_ONCE = 1 << 16
#: Word parts per block, and the most blocks whose words are segmented together.
PARTS_PER_BLOCK = 4
GROUP_BLOCKS = 4096
UNKNOWN_PENALTY = 10.0
#: Characters of the longest word that is exploded whole, and of one chunk of longer words.
LONG_WORD = 128
CHUNK = 128


@dataclass(frozen=True)
class Model:
    """Piece table of a model file: ordinary pieces with scores, byte pieces and the bytes of every id."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]
    surface: tuple[bytes, ...]
    cuts: str

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @property
    def unknown_score(self) -> float:
        return min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_MODEL)


def load_model(path: str) -> Model:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, surface = {}, [0] * 256, []
    for k in range(sp.get_piece_size()):
        piece = sp.id_to_piece(k)
        if sp.is_byte(k):
            byte_ids[int(piece[3:5], 16)] = k
            surface.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k):
            surface.append(b"")
        else:
            pieces[piece] = (k, sp.get_score(k))
            surface.append(piece.replace(SPACE, " ").encode())
    if any(re.search(f"[^{SPACE}]{SPACE}", p) or (_JOIN in p and len(p) > 1) for p in pieces):
        raise ValueError("pieces must not cross from a word to the blank behind it, or join character 1 to others")
    inside = {c for p in pieces if len(p) > 1 for c in p}
    return Model(pieces, tuple(byte_ids), tuple(surface), "".join(c for c in "\n\r\t" if c not in inside))


def word_pattern(model: Model) -> re.Pattern:
    """Words of a normalised text: letters, one digit, or other characters, with the run of U+2581 before them.

    Holds for tables in which no piece mixes these classes; else words end at U+2581 only. A control character
    that no longer piece contains is a word of its own.
    """
    cuts = re.escape(model.cuts + _JOIN)
    numbers = "".join(sorted({c for p in model.pieces for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()}))
    letter, other = f"[^\\W\\d_{re.escape(numbers)}]", f"(?:[^\\w{SPACE}{cuts}]|[_{re.escape(numbers)}])"
    fine = re.compile(f"{SPACE}*{letter}+|{SPACE}*\\d|{SPACE}*{other}+|{SPACE}+|[{cuts}]")
    if all(fine.fullmatch(p) for p in model.pieces):
        return fine
    return re.compile(f"{SPACE}*[^{SPACE}{cuts}]+|{SPACE}+|[{cuts}]")


def normalise(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


# ---------------------------------------------------------------- lattice


def _substrings(words: DataFrame, longest: int) -> DataFrame:
    """(wid, part, word, blocks, e, s, piece): substrings by end position, from the longest to the shortest.

    ``word`` and ``blocks`` stay with the last substring of a word only.
    """
    ends = words.select("wid", "part", "word", "blocks", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("e"))
    sizes = F.sequence(F.least("e", F.lit(longest)), F.lit(1), F.lit(-1))
    sized = ends.select("wid", "part", "word", "blocks", "e", F.explode(sizes).alias("l"))
    last = (F.col("l") == 1) & (F.col("e") == F.length("word"))
    return sized.select(
        "wid",
        "part",
        F.when(last, F.col("word")).alias("word"),
        F.when(last, F.col("blocks")).alias("blocks"),
        "e",
        (F.col("e") - F.col("l")).alias("s"),
        F.substring("word", F.col("e") - F.col("l") + 1, F.col("l")).alias("piece"),
    )


def _totals(edges: Column, start: Column, low: Column) -> Column:
    """The best total of every position from ``low`` on, folded over edges in order of (e, s); ``start`` has the first ones.

    The first edge of a position appends, a better one replaces. The state is plain numbers: which edges are best
    follows from the totals, and building structures in every step would cost several times the search.
    """

    def step(acc: Column, x: Column) -> Column:
        total = F.get(acc, x["s"] - low) + x["w"]
        n = F.size(acc)
        return (
            F.when(n + low == x["e"], F.array_append(acc, total))
            .when(total > F.get(acc, n - 1), F.array_append(F.slice(acc, 1, n - 1), total))
            .otherwise(acc)
        )

    return F.aggregate(edges, start, step)


_NO_IDS = "cast(array() as array<int>)"


def _back(edges: Column, totals: Column, low: Column, start: Column, finish) -> Column:
    """Follows the best path over the edges of some positions, from the last to the first.

    The state (at, s, id, ids): the path has ``ids`` behind position ``at``, last first, and the edge (s, at, id) before it,
    the longest met so far. That edge is closed when edges end at its start.
    """

    def step(acc: Column, x: Column) -> Column:
        best = F.get(totals, x["s"] - low) + x["w"] == F.get(totals, x["e"] - low)

        def state(at: Column, ids: Column) -> Column:
            return F.struct(at.alias("at"), x["s"].alias("s"), x["id"].alias("id"), ids.alias("ids"))

        return (
            F.when((x["e"] == acc["s"]) & best, state(acc["s"], F.array_append(acc["ids"], acc["id"])))
            .when((x["e"] == acc["at"]) & best, state(acc["at"], acc["ids"]))
            .otherwise(acc)
        )

    return F.aggregate(F.reverse(edges), start, step, finish)


def _path(edges: Column, totals: Column) -> Column:
    """Ids along the best path, in reading order."""
    none = F.lit(-1)
    start = F.struct((F.size(totals) - 1).alias("at"), none.alias("s"), none.alias("id"), F.expr(_NO_IDS).alias("ids"))
    return _back(edges, totals, F.lit(0), start, lambda acc: F.reverse(F.array_append(acc["ids"], acc["id"])))


def segment(words: DataFrame, model: Model) -> DataFrame:
    """(part, word, blocks, ids) for distinct (part, word) that are hash partitioned by part.

    ``ids`` are in reading order; a negative id -c stands for the code point c without a piece.
    """
    numbered = words.withColumn("wid", F.monotonically_increasing_id())
    known = _edges(_substrings(numbered, model.longest), model)
    # numbers rise in the order of the rows, so sorting them for the groups costs one pass
    grouped = known.groupBy("wid", "part").agg(
        F.first("word", ignorenulls=True).alias("word"),
        F.first("blocks", ignorenulls=True).alias("blocks"),
        F.sort_array(F.collect_list("edge")).alias("edges"),
    )
    totals = grouped.withColumn("totals", _totals(F.col("edges"), F.array(F.lit(0.0)), F.lit(0)))
    return totals.select("part", "word", "blocks", _path(F.col("edges"), F.col("totals")).alias("ids"))


def _edges(cut: DataFrame, model: Model) -> DataFrame:
    """Substrings that are pieces, and single characters, with ``edge`` (e, s, id, w)."""
    rows = [(p, k, s) for p, (k, s) in model.pieces.items()]
    table = cut.sparkSession.createDataFrame(rows, "piece string, id int, w double")
    edge = F.struct(
        "e", "s", F.coalesce("id", -F.ascii("piece")).alias("id"), F.coalesce("w", F.lit(model.unknown_score)).alias("w")
    )
    known = cut.join(F.broadcast(table), "piece", "left").where("id is not null or s = e - 1")
    return known.withColumn("edge", edge)


def segment_long(words: DataFrame, model: Model) -> DataFrame:
    """(word, ids) for distinct words of any length, worked on in chunks of ``CHUNK`` end positions.

    A chunk holds the characters of its ends and the ``longest - 1`` before them. Words are addressed by their
    SHA-256 and joined back at the end.
    """
    longest = model.longest
    keyed = words.select(F.sha2("word", 256).alias("wid"), "word")
    starts = keyed.select("wid", "word", F.explode(F.sequence(F.lit(0), F.length("word") - 1, F.lit(CHUNK))).alias("a"))
    base = F.greatest(F.col("a") - F.lit(longest - 1), F.lit(0))
    chunks = starts.select(
        "wid", "a", base.alias("base"), F.substring("word", base + 1, F.col("a") + CHUNK - base).alias("chunk")
    ).repartition("wid", "a")
    inside = F.sequence(F.col("a") - F.col("base") + 1, F.length("chunk"))
    ends = chunks.select("wid", "a", "base", "chunk", F.explode(inside).alias("i"))
    sized = ends.select("*", F.explode(F.sequence(F.lit(1), F.least("i", F.lit(longest)))).alias("l"))
    cut = sized.select(
        "wid", "a", (F.col("base") + F.col("i")).alias("e"), (F.col("base") + F.col("i") - F.col("l")).alias("s"),
        F.substring("chunk", F.col("i") - F.col("l") + 1, F.col("l")).alias("piece"),
    )
    per_chunk = _edges(cut, model).groupBy("wid", "a").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    grouped = per_chunk.groupBy("wid").agg(F.sort_array(F.collect_list(F.struct("a", "edges"))).alias("chunks"))
    totals = grouped.withColumn("totals", _chunked_totals(F.col("chunks"), longest))
    return keyed.join(totals.select("wid", _chunked_path(F.col("chunks"), F.col("totals")).alias("ids")), "wid").select("word", "ids")


def _chunked_totals(chunks: Column, longest: int) -> Column:
    """(low, t) of every chunk: the best totals from position low on; a chunk starts from the last ``longest`` positions."""

    def step(acc: Column, x: Column) -> Column:
        before = F.element_at(acc, -1)
        n = F.size(before["t"])
        over = F.greatest(n - F.lit(longest), F.lit(0))
        low = before["low"] + over
        return F.array_append(acc, F.struct(low.alias("low"), _totals(x["edges"], F.slice(before["t"], over + 1, F.lit(longest)), low).alias("t")))

    origin = F.array(F.struct(F.lit(0).alias("low"), F.array(F.lit(0.0)).alias("t")))
    return F.aggregate(chunks, origin, step, lambda acc: F.slice(acc, 2, F.size(acc) - 1))


def _chunked_path(chunks: Column, totals: Column) -> Column:
    """Ids along the best path, in reading order, followed from the last chunk to the first."""
    last = F.element_at(totals, -1)
    none = F.lit(-1)
    start = F.struct(
        (last["low"] + F.size(last["t"]) - 1).alias("at"),
        none.alias("s"),
        none.alias("id"),
        F.expr("cast(array() as array<array<int>>)").alias("ids"),
    )

    def step(acc: Column, c: Column) -> Column:
        here = F.get(totals, c)
        begin = F.struct(acc["at"].alias("at"), acc["s"].alias("s"), acc["id"].alias("id"), F.expr(_NO_IDS).alias("ids"))

        def finished(x: Column) -> Column:
            return F.struct(x["at"].alias("at"), x["s"].alias("s"), x["id"].alias("id"), F.array_append(acc["ids"], x["ids"]).alias("ids"))

        return _back(F.get(chunks, c)["edges"], here["t"], here["low"], begin, finished)

    joined = lambda acc: F.reverse(F.array_append(F.flatten(acc["ids"]), acc["id"]))
    return F.aggregate(F.sequence(F.size(chunks) - 1, F.lit(0), F.lit(-1)), start, step, joined)


# ---------------------------------------------------------------- blocks of texts

_BLOCK = pa.schema([("block", pa.int64()), ("blob", pa.binary()), ("wide", pa.bool_())])


def _wide(text: str) -> bool:
    """Whether the text may hold a word of more than ``LONG_WORD`` characters."""
    half = LONG_WORD // 2
    spaced = text.replace(SPACE, " ") if SPACE in text else text
    return " " * half in spaced or max(map(len, spaced.split(" "))) > half


def _pack(rows: list[tuple[int | None, str | None]]) -> bytes:
    table = pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.large_string())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def _unpack(blob: bytes) -> tuple[list[int | None], list[str]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    table = pa.ipc.open_stream(raw).read_all()
    return table.column("id").to_pylist(), [t or "" for t in table.column("text").to_pylist()]


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """Documents packed into numbered blocks and stored in buckets by block number."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def emit(wide: bool) -> pa.RecordBatch:
            return batch_of(_BLOCK, [[uuid.uuid4().int >> 65], [_pack(held[wide])], [wide]])

        for b in slices(batches):
            for row in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                wide = bool(row[1]) and _wide(row[1])
                held[wide].append(row)
                size[wide] += 16 + len(row[1] or "")
                if size[wide] >= block_bytes:
                    yield emit(wide)
                    held[wide], size[wide] = [], 0
        for wide, rows in held.items():
            if rows:
                yield emit(wide)
        release()

    packed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "block long, blob binary, wide boolean"
    )
    name = f"lacuna_blocks_{uuid.uuid4().hex[:12]}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    writer = packed.write.bucketBy(buckets, "block").option("path", f"{run_folder(spark)}/{name}").option("compression", "uncompressed")
    writer.saveAsTable(name)
    stored = spark.table(name)
    stored.schema  # resolved before the name goes; the files stay with the run folder
    spark.sql(f"DROP TABLE {name}")
    return stored


@dataclass(frozen=True)
class Units:
    """What texts consist of, by numbers: units of a text, words of a unit.

    A unit is what stands between two blanks, or an irregular text as a whole. Unit k has the words
    ``word_of[unit_at[k]:unit_at[k + 1]]``, text k the units ``unit_of[text_at[k]:text_at[k + 1]]``.
    """

    words: pa.Array
    word_of: np.ndarray
    unit_at: np.ndarray
    unit_of: np.ndarray
    text_at: np.ndarray


def _regular(text: str) -> bool:
    """Whether blanks stand single and between words, so that splitting at them gives the words' places."""
    return bool(text) and "  " not in text and text[0] != " " and text[-1] != " " and SPACE not in text and _JOIN not in text


def _objects(values: pa.Array) -> list:
    """As ``to_pylist``, without a scalar object for every value on the way."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _units(texts: list[str], pattern: re.Pattern) -> Units:
    """The distinct units and words of ``texts``. What stands between blanks is cut into words once, however often it occurs."""
    regular = np.array([_regular(t) for t in texts], bool)
    split = pc.split_pattern(pa.array([t for t, r in zip(texts, regular, strict=True) if r], pa.large_string()), " ")
    coded = split.flatten().dictionary_encode()
    n = len(coded.dictionary)
    letters = np.fromiter(map(str.isalpha, _objects(coded.dictionary)), bool, n)
    # units of letters are one word and come first, the others are searched
    order = np.argsort(~letters, kind="stable")
    number = np.empty(n, np.int32)
    number[order] = np.arange(n)
    met = int(letters.sum())
    alone = coded.dictionary.take(pa.array(order[:met]))
    found, ends = [pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), alone, pa.scalar("", pa.large_string()))], [np.arange(met + 1)]
    for k in range(met, n, UNITS_AT_ONCE):
        # character 1 is a word of its own: one search over all units, each closed by it
        spaced = _objects(coded.dictionary.take(pa.array(order[k : k + UNITS_AT_ONCE])))
        words = pa.array(pattern.findall(SPACE + f"{_JOIN}{SPACE}".join(spaced) + _JOIN), pa.large_string())
        inside = pc.not_equal(words, _JOIN)
        closed = np.flatnonzero(~inside.to_numpy(zero_copy_only=False))
        ends.append(met + closed - np.arange(len(closed)))
        met = int(ends[-1][-1])
        found.append(words.filter(inside))
    for t, r in zip(texts, regular.tolist(), strict=True):
        if not r:
            found.append(pa.array(pattern.findall(normalise(t)), pa.large_string()))
            met += len(found[-1])
            ends.append(np.array([met], np.int64))
    words = pa.concat_arrays(found).dictionary_encode()
    sizes = np.ones(len(texts), np.int64)
    sizes[regular] = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    text_at = np.concatenate([[0], np.cumsum(sizes)])
    whole = np.zeros(text_at[-1], bool)
    whole[text_at[:-1][~regular]] = True
    unit_of = np.empty(len(whole), np.int32)
    unit_of[~whole] = number[coded.indices.to_numpy(zero_copy_only=False)]
    unit_of[whole] = n + np.arange(whole.sum())
    return Units(words.dictionary, words.indices.to_numpy(zero_copy_only=False), np.concatenate(ends), unit_of, text_at)


def _parted(words: pa.Array, group: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, at, order): words order[at[k]:at[k + 1]] are those of part[k], sorted, without long ones and character 1.

    Parts of different block groups are different.
    """
    short = pc.and_(pc.less_equal(pc.utf8_length(words), LONG_WORD), pc.not_equal(words, _JOIN))
    order = np.flatnonzero(short.to_numpy(zero_copy_only=False))
    order = order[pc.sort_indices(words.take(pa.array(order))).to_numpy()]
    raw = _objects(words.take(pa.array(order)).cast(pa.large_binary()))
    part = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % parts
    by_part = np.argsort(part, kind="stable")
    numbers, at = np.unique(part[by_part], return_index=True)
    return group * parts + numbers, np.append(at, len(order)), order[by_part]


def _words(blocks: DataFrame, pattern: re.Pattern, groups: int, parts: int) -> DataFrame:
    """(part, block, words): the distinct words of every block by part, sorted and joined by character 1."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob in zip(b.column("block").to_pylist(), b.column("blob"), strict=True):
                words = _units(_unpack(blob.as_buffer())[1], pattern).words
                part, at, order = _parted(words, block % groups, parts)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), words.take(pa.array(order)))
                yield batch_of(schema, [part, np.full(len(part), block), pc.binary_join(lists, pa.scalar(_JOIN, pa.large_string())).cast(pa.string())])
        release()

    return blocks.mapInArrow(run, "part long, block long, words string")


def _long_words(blocks: DataFrame, pattern: re.Pattern) -> DataFrame:
    """(block, word): the distinct long words of every block."""
    schema = pa.schema([("block", pa.int64()), ("word", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob in zip(b.column("block").to_pylist(), b.column("blob"), strict=True):
                words = _units(_unpack(blob.as_buffer())[1], pattern).words
                for w in words.filter(pc.greater(pc.utf8_length(words), LONG_WORD)).to_pylist():
                    yield batch_of(schema, [[block], [w]])
        release()

    return blocks.mapInArrow(run, "block long, word string")


def _stretches(values: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[at[k]:at[k] + sizes[k]] for every k, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(at - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _unit_ids(units: Units, answer: pa.Table, group: int, parts: int, model: Model) -> pa.Array:
    """The ids of every unit, from the answer to its block: rows of parts, and of long words."""
    by_part = answer.filter(pc.is_null(answer.column("word"))).sort_by("part").column("ids").combine_chunks()
    long = answer.filter(pc.is_valid(answer.column("word")))
    part, _, order = _parted(units.words, group, parts)
    values = by_part.flatten().to_numpy(zero_copy_only=False)
    ends = np.flatnonzero(values == _END)
    if len(ends) != len(order) or len(by_part) != len(part):
        raise ValueError("the answer does not belong to the words of the block")
    at, sizes = np.zeros(len(units.words), np.int64), np.zeros(len(units.words), np.int64)
    at[order] = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    sizes[order] = ends - at[order]
    places = pc.index_in(long.column("word").cast(pa.large_string()).combine_chunks(), units.words).to_pylist()
    more = [(k, x.values.to_numpy()) for k, x in zip(places, long.column("ids"), strict=True)]
    one = units.words.index(_JOIN).as_py()
    if one >= 0:
        more.append((one, np.array([model.pieces[_JOIN][0] if _JOIN in model.pieces else model.byte_ids[1]])))
    for k, x in more:
        at[k], sizes[k] = len(values), len(x)
        values = np.concatenate([values, x])
    values, moved = _with_bytes(values, model)
    sizes = moved[at + sizes] - moved[at]
    ids = _stretches(values, moved[at][units.word_of], sizes[units.word_of])
    ends = np.concatenate([[0], np.cumsum(sizes[units.word_of])])
    return pa.LargeListArray.from_arrays(pa.array(ends[units.unit_at], pa.int64()), pa.array(ids, pa.int32()))


def encode(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, ids, n_tokens, decoded_sha256): token ids of highest total score per text, and the hash of what they decode to.

    Null and empty texts have no tokens. Repeated rows give one row each, null ids stay null. Other columns
    are not read. Decoding gives the text back, but for U+2581 itself, which becomes a blank.
    """
    pattern = word_pattern(model)
    blocks = _blocks(docs, id_col, text_col, block_bytes)
    n_blocks = max(1, blocks.select("block").count())
    groups = -(-n_blocks // GROUP_BLOCKS)
    parts = max(1, PARTS_PER_BLOCK * n_blocks // groups)
    sent = _words(blocks, pattern, groups, parts).repartition(parts * groups, "part")
    met = sent.select("part", "block", F.explode(F.split("words", _JOIN)).alias("word"))
    distinct = met.groupBy("part", "word").agg(F.collect_set("block").alias("blocks"))
    found = segment(distinct, model).select("part", "word", F.explode("blocks").alias("block"), "ids")
    sorted_words = F.sort_array(F.collect_list(F.struct("word", "ids")))
    listed = F.flatten(F.transform(sorted_words, lambda x: F.concat(x["ids"], F.array(F.lit(_END)))))
    back = found.groupBy("part", "block").agg(listed.alias("ids")).withColumn("word", F.lit(None).cast("string"))
    long = _long_words(blocks.where("wide"), pattern)
    long_ids = segment_long(long.select("word").distinct(), model).join(long, "word")
    back = back.unionByName(long_ids.select(F.lit(-1).cast("long").alias("part"), "block", "ids", "word"))
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("decoded_sha256", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        surface = pa.array(model.surface, pa.large_binary())
        out = []
        for block, blob in zip(left.column("block").to_pylist(), left.column("blob"), strict=True):
            ids, texts = _unpack(blob.as_buffer())
            units = _units(texts, pattern)
            del texts
            of_units = _unit_ids(units, right, block % groups, parts, model)
            for k in range(0, len(ids), 1000):
                text_at = units.text_at[k : k + 1001]
                each = of_units.take(pa.array(units.unit_of[text_at[0] : text_at[-1]]))
                tokens = each.flatten()
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(each).to_numpy(zero_copy_only=False))])[text_at - text_at[0]]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens)
                hashes = [hashlib.sha256(x.encode()).hexdigest() for x in _decoded(tokens, ends, surface)]
                out.append(
                    pa.RecordBatch.from_arrays(
                        [pa.array(ids[k : k + 1000], pa.int64()), lists, pa.array(np.diff(ends), pa.int64()), pa.array(hashes, pa.string())],
                        schema=schema,
                    )
                )
        release()
        return pa.Table.from_batches(out, schema)

    together = blocks.groupBy("block").cogroup(back.groupBy("block"))
    return together.applyInArrow(run, "id long, ids array<int>, n_tokens long, decoded_sha256 string")


def _with_bytes(values: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Ids with characters that have no piece as their bytes, and the new place of every old one (and of the end)."""
    unknown = (values < 0) & (values != _END)
    points, which = np.unique(-values[unknown], return_inverse=True)
    raw = [chr(c).encode() for c in points.tolist()]
    sizes = np.ones(len(values), np.int64)
    sizes[unknown] = np.array([len(x) for x in raw], np.int64)[which]
    moved = np.concatenate([[0], np.cumsum(sizes)])
    out = np.repeat(values, sizes).astype(np.int32)
    for j in range(4):
        nth = np.array([model.byte_ids[x[j]] if j < len(x) else 0 for x in raw], np.int32)[which]
        has = np.array([j < len(x) for x in raw], bool)[which]
        out[moved[:-1][unknown][has] + j] = nth[has]
    return out, moved


def _decoded(tokens: pa.Array, ends: np.ndarray, surface: pa.Array) -> Iterator[str]:
    """The text of every list tokens[ends[k]:ends[k + 1]]."""
    pieces = surface.take(tokens)
    at = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset + ends]
    raw = memoryview(pieces.buffers()[2] or b"")
    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield _text_of(raw[a:z].tobytes())


def _text_of(raw: bytes) -> str:
    return raw.removeprefix(b" ").decode("utf-8", "replace")


def decode_ids(ids: list[int], model: Model) -> str:
    return _text_of(b"".join(map(model.surface.__getitem__, ids)))


def decode(encoded: DataFrame, model: Model, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the texts that the ids stand for. Null ids decode to an empty text, ids out of range fail."""
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch_of(schema, [b.column("id").to_pylist(), [decode_ids(x or [], model) for x in b.column("ids").to_pylist()]])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string")


def default_model(spark: SparkSession) -> Model:
    """The installed public model; ``spark.lacuna.sentencepiece.model`` names another file."""
    path = spark.conf.get("spark.lacuna.sentencepiece.model", None)
    return load_model(path or default_model_path())
