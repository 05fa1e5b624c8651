"""A saved index as generations: segments that are written once, and a small file that says which of them count.

<path>/generations/N.json        segments and words of generation N; the highest N is the index
<path>/<table>/segment=S/source=X/   chunks, lengths, postings, stats, stems of a segment
<path>/words/segment=S/          terms that no segment before had, with their stems
<path>/dead/segment=G/           (of, source, chunk_id): rows of older segments that no longer count

Whatever is written counts only from the moment that the next generation's file has its name, in one
step and only if no other writer was there first. Until then readers see the old index, and one that
has begun keeps its segments, which stay until ``vacuum``. A source is replaced, and a changed page
taken over, by a new segment and rows of ``dead``; statistics add up over segments, so a segment
that replaces chunks counts them with a minus.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import passing, setting, settled
from . import search, tallies

_SEGMENT = "segment string, source string"
SCHEMAS = {
    "chunks": f"url string, path string, title string, heading_path array<string>, anchor string, body string, token_count int, ord int, chunk_id long, {_SEGMENT}",
    "lengths": f"chunk_id long, path string, ord int, dl long, {_SEGMENT}",
    "postings": f"chunk_id long, dl long, col int, pos int, term string, {_SEGMENT}",
    "stats": f"n_all long, total long, {_SEGMENT}",
    "stems": f"stem string, df long, {_SEGMENT}",
    "words": "term string, stem string, segment string",
}
DEAD = "of string, source string, chunk_id long"
#: Segments from which on the small ones are merged.
MERGE = 8
#: Sources up to which a task writes its postings as it makes them, a file for each source that it has; postings of more are
#: dealt by ranges first. Rows of a page of such a file, which is what a lookup of a term reads.
WRITERS, PAGE = 32, 2000
#: What is written once and read seldom. Bytes of a batch that workers get: they hold a few copies of it.
ZSTD, BATCH = {"compression": "zstd"}, 8 << 20


class Conflict(RuntimeError):
    """Another writer made the next generation first."""


@dataclass
class State:
    """A generation: its number, chunks of each segment (as written), its segments' tables, segments with words, and how
    many whole sources and single chunks of segments are dead."""

    number: int = 0
    segments: dict[str, int] = field(default_factory=dict)
    tables: dict[str, list[str]] = field(default_factory=dict)
    dead: str | None = None
    dead_sources: int = 0
    dead_chunks: int = 0


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def current(spark: SparkSession, path: str) -> State:
    fs, folder = _fs(spark, f"{path}/generations")
    if not fs.exists(folder):
        return State()
    names = sorted(x.getPath().getName() for x in fs.listStatus(folder))
    names = [n for n in names if n.endswith(".json")]
    if not names:
        return State()
    return State(**json.loads(spark.read.text(f"{path}/generations/{names[-1]}", wholetext=True).first()[0]))


def _commit(spark: SparkSession, path: str, state: State) -> State:
    """Make ``state`` the next generation: written beside its place and renamed, which fails if the name is taken."""
    state = replace(state, number=state.number + 1)
    fs, part = _fs(spark, f"{path}/generations/{uuid.uuid4().hex}.part")
    _, place = _fs(spark, f"{path}/generations/{state.number:012}.json")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(state.__dict__).encode()))
    out.close()
    jvm = spark._jvm
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(part, place, none)
    except Py4JJavaError as e:
        fs.delete(part, False)
        raise Conflict(f"generation {state.number} of {path} is there already") from e
    return state


def _read(spark: SparkSession, path: str, state: State, table: str, segments: list[str] | None = None) -> DataFrame:
    """All rows of a table in segments of a generation, dead ones too."""
    there = [s for s in state.tables.get(table, []) if segments is None or s in segments]
    if not there:
        return spark.createDataFrame([], SCHEMAS[table])
    return spark.read.schema(SCHEMAS[table]).option("basePath", f"{path}/{table}").parquet(*(f"{path}/{table}/segment={s}" for s in there))


def _dead(spark: SparkSession, path: str, state: State) -> DataFrame:
    if not state.dead:
        return spark.createDataFrame([], DEAD)
    return spark.read.schema(DEAD).parquet(f"{path}/dead/segment={state.dead}")


def _live(df: DataFrame, path: str, state: State) -> DataFrame:
    dead = _dead(df.sparkSession, path, state).withColumnRenamed("of", "segment")
    if state.dead_sources:
        df = df.join(dead.where("chunk_id is null").select("segment", "source"), ["segment", "source"], "left_anti")
    if state.dead_chunks and "chunk_id" in df.columns:
        df = df.join(dead.where("chunk_id is not null"), ["segment", "source", "chunk_id"], "left_anti")
    return df


def _tables(spark: SparkSession, path: str, state: State, segments: list[str] | None = None) -> dict[str, DataFrame]:
    """The rows that count, with their segments."""
    return {t: _live(_read(spark, path, state, t, segments), path, state) for t in ("chunks", "lengths", "postings", "stats", "stems")} | {"words": _read(spark, path, state, "words", segments)}


def load(spark: SparkSession, path: str, stemmed: bool = True) -> search.Index:
    """The index as it is now; one that is not there yet, or whose sources are all gone, has no rows."""
    t = _tables(spark, path, current(spark, path))
    stats = t["stats"].groupBy("source").agg(F.sum("n_all").alias("n_all"), F.sum("total").alias("total")).where("n_all > 0")
    return search.Index(*(t[x].drop("segment") for x in ("chunks", "postings", "lengths", "words")), stats, stemmed, stems=t["stems"].drop("segment"))


def _write(index: search.Index, path: str, name: str, table: str) -> None:
    """One table of a segment. Postings of few sources stay in the task that makes them, in sorted regions: nothing is
    shuffled, and a source's commonest term is split as its chunks are. Those of many sources are dealt by ranges, so that
    a task writes files for the few sources of its range only. Chunks are sorted by their ids, so that few row groups of a
    file are read for the best hits."""
    df = {"chunks": index.chunks, "lengths": index.lengths, "postings": index.postings, "stats": index.stats, "stems": index.stems, "words": index.vocabulary}[table]
    if table == "postings" and index.tokenised is not None:
        few = index.lengths.select("source").distinct().limit(WRITERS + 1).count() <= WRITERS
        if few:
            rows = tallies.rows(index.tokenised)
        else:  # runs are dealt and sorted, which are far fewer than tokens
            dealt = tallies.runs(index.tokenised).repartitionByRange("source", "term", "first").sortWithinPartitions("source", "term")
            rows = dealt.select("source", "term", F.inline("run")).select("chunk_id", "dl", "col", "pos", "term", "source")
        with setting(rows.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(WRITERS if few else 0)):  # else Spark sorts by source
            rows.write.mode("overwrite").options(**ZSTD, **{"parquet.page.row.count.limit": str(PAGE)}).partitionBy("source").parquet(f"{path}/{table}/segment={name}")
        return
    if table == "postings":
        df = df.repartitionByRange("source", "term", "chunk_id")
    df = df.sortWithinPartitions(*{"chunks": ["source", "chunk_id"], "lengths": ["source", "chunk_id"], "postings": ["source", "term", "chunk_id"], "stats": ["source"], "stems": ["source", "stem"], "words": ["stem"]}[table])
    out = df.write.mode("overwrite").options(**ZSTD)
    (out if table == "words" else out.partitionBy("source")).parquet(f"{path}/{table}/segment={name}")


def _tokens(chunks: DataFrame) -> DataFrame:
    """Tokens of saved chunks, those of a text joined by blanks, which take less than lists of them do."""
    joined = F.transform("tokens_", lambda t: F.array_join(t, " "))
    found = search.tokenized(chunks.withColumnRenamed("chunk_id", "id_"))
    return found.select("source", F.col("id_").alias("chunk_id"), "path", "ord", "dl_", joined.alias("joined_"))


def _counted(index: search.Index) -> DataFrame:
    """Words (term, stem; source null) and counts of chunks by stem (source, stem, df; term null), each once."""
    return tallies.told(index.tokenised, index.stemmed).groupBy("source", "term", "stem").agg(F.sum("df").alias("df"))


def _segment(index: search.Index, path: str, state: State, less: search.Index | None = None, gone: DataFrame | None = None) -> tuple[str, State]:
    """Write a segment and its new words, its stems' counts less those of ``less``, its stats with those of ``gone``; the
    state that has it too. What is written on the way is deleted as soon as it is not needed."""
    spark, name = index.chunks.sparkSession, uuid.uuid4().hex
    old = _read(spark, path, state, "words")
    tables = {t: [*state.tables.get(t, []), name] for t in SCHEMAS}

    def write(index: search.Index, words: DataFrame, stems: DataFrame, *names: str) -> None:
        if less is not None:
            stems = stems.unionByName(_counted(less).where("term is null").select("source", "stem", (-F.col("df")).alias("df"))).groupBy("source", "stem").agg(F.sum("df").alias("df")).where("df != 0")
        index = replace(index, stems=stems, vocabulary=words.join(old.select("term"), "term", "left_anti") if state.tables.get("words") else words)
        for table in names:
            _write(index, path, name, table)

    def write_tokenised(index: search.Index, *names: str) -> None:
        stats = index.lengths.groupBy("source").agg(F.count("*").alias("n_all"), F.sum("dl").alias("total"))
        if gone is not None:
            stats = stats.unionByName(gone).groupBy("source").agg(F.sum("n_all").alias("n_all"), F.sum("total").alias("total"))
        index = replace(index, stats=stats)
        with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH)), passing(_counted(index), "told", **ZSTD) as told:
            write(index, told.where("term is not null").select("term", "stem"), told.where("term is null").select("source", "stem", "df"), "stems", "words")
        with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH)):
            for table in names:
                _write(index, path, name, table)

    if index.tokenised is None:
        with passing(index.vocabulary, "words", **ZSTD) as words:
            write(index, words, index.stems, *SCHEMAS)
    elif index.told:
        write_tokenised(index, "chunks", "lengths", "postings", "stats")
    else:  # chunks are made once, and tokenised as they are saved
        _write(index, path, name, "chunks")
        with passing(_tokens(_read(spark, path, replace(state, tables=tables), "chunks", [name])), "tokens", **ZSTD) as tokens:
            write_tokenised(replace(index, tokenised=tokens, lengths=search.lengths(tokens)), "lengths", "postings", "stats")
    new = replace(state, tables=tables, segments=dict(state.segments))
    new.segments[name] = _read(spark, path, new, "lengths", [name]).count()
    return name, new


def _buried(spark: SparkSession, path: str, state: State, dead: DataFrame) -> State:
    """A state with more dead rows. Segments of which nothing is left, and what was dead in them, go."""
    name = uuid.uuid4().hex
    all_ = settled(_dead(spark, path, state).unionByName(dead).distinct(), "dead")
    whole = all_.where("chunk_id is null").select(F.col("of").alias("segment"), "source")
    left = {r.segment for r in _read(spark, path, state, "stats").select("segment", "source").join(whole, ["segment", "source"], "left_anti").select("segment").distinct().collect()}
    # a chunk of a source that is dead as a whole needs no row of its own
    kept = all_.where(F.col("of").isin(sorted(left)))
    covered = whole.select(F.col("segment").alias("of"), "source")
    kept = settled(kept.where("chunk_id is null").unionByName(kept.where("chunk_id is not null").join(covered, ["of", "source"], "left_anti").select("of", "source", "chunk_id")), "kept")
    n = kept.agg(F.count_if(F.col("chunk_id").isNull()).alias("a"), F.count("chunk_id").alias("b")).first()
    if n.a or n.b:
        kept.write.parquet(f"{path}/dead/segment={name}")
    tables = {t: [s for s in ss if s in left or t == "words"] for t, ss in state.tables.items()}
    return replace(state, segments={s: k for s, k in state.segments.items() if s in left}, tables=tables, dead=name if n.a or n.b else None, dead_sources=n.a, dead_chunks=n.b)


def save(index: search.Index, path: str) -> None:
    """A new segment with the index's sources, each replaced as a whole; other sources stay."""
    spark = index.chunks.sparkSession
    state = current(spark, path)
    name, new = _segment(index, path, state)
    if state.segments:
        own = _read(spark, path, new, "stats", [name]).select("source")
        dead = _read(spark, path, state, "stats").join(own, "source", "left_semi").select(F.col("segment").alias("of"), "source", F.lit(None).cast("long").alias("chunk_id"))
        new = _buried(spark, path, new, dead)
    _commit(spark, path, new)


def remove(spark: SparkSession, path: str, sources: list[str]) -> None:
    """Sources go; unknown ones are none."""
    state = current(spark, path)
    if state.segments:
        dead = _read(spark, path, state, "stats").where(F.col("source").isin(sources)).select(F.col("segment").alias("of"), "source", F.lit(None).cast("long").alias("chunk_id"))
        _commit(spark, path, _buried(spark, path, state, dead))


def update(index: search.Index, gone: DataFrame, path: str) -> None:
    """A new segment with the chunks of added and changed pages; chunks that pages of ``gone(source, path)`` had go.

    Only these chunks are written. From MERGE segments on the small ones are merged.
    """
    spark = index.chunks.sparkSession
    state = current(spark, path)
    lengths = _live(_read(spark, path, state, "lengths"), path, state)
    dead = settled(lengths.join(gone.select("source", "path").distinct(), ["source", "path"], "left_semi").select("segment", "source", "chunk_id", "dl"), "dead")
    less = dead.groupBy("source").agg((-F.count("*")).alias("n_all"), (-F.sum("dl")).alias("total"))
    # texts of the chunks that go are few; their postings lie among all the others
    chunks = _read(spark, path, state, "chunks").join(dead.select("segment", "source", "chunk_id"), ["segment", "source", "chunk_id"], "left_semi").drop("segment")
    _, new = _segment(index, path, state, search.build(settled(search.tokenized(chunks), "less"), index.stemmed), less)
    if not dead.isEmpty():
        new = _buried(spark, path, new, dead.select(F.col("segment").alias("of"), "source", "chunk_id"))
    new = _commit(spark, path, new)
    if len(new.segments) >= MERGE:
        merge(spark, path)


def merge(spark: SparkSession, path: str, whole: bool = False) -> None:
    """Segments that have less than half of all chunks become one, or all of them do; their dead rows go."""
    state = current(spark, path)
    total = sum(state.segments.values())
    small = [s for s, n in state.segments.items() if whole or 2 * n < total]
    if len(small) < 2 and not (whole and small):
        return
    t = _tables(spark, path, state, small)
    stats = t["stats"].groupBy("source").agg(F.sum("n_all").alias("n_all"), F.sum("total").alias("total"))
    stems = t["stems"].groupBy("source", "stem").agg(F.sum("df").alias("df")).where("df != 0")
    index = search.Index(*(t[x].drop("segment") for x in ("chunks", "postings", "lengths")), _read(spark, path, state, "words").drop("segment"), stats, stems=stems)
    kept = {k: [s for s in ss if s not in small] for k, ss in state.tables.items()} | {"words": []}  # words are written anew
    _, new = _segment(index, path, replace(state, tables=kept, segments={s: n for s, n in state.segments.items() if s not in small}))
    dead = _dead(spark, path, state).where(~F.col("of").isin(small))
    _commit(spark, path, _buried(spark, path, replace(new, dead=None), dead))


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete what the current generation does not need; readers of older ones must be done. -> names deleted."""
    state, out = current(spark, path), []
    for table in (*SCHEMAS, "dead"):
        fs, folder = _fs(spark, f"{path}/{table}")
        need = {f"segment={s}" for s in ([state.dead] if table == "dead" else state.tables.get(table, []))}
        for x in list(fs.listStatus(folder)) if fs.exists(folder) else []:
            name = x.getPath().getName()
            if name.startswith("segment=") and name not in need:
                fs.delete(x.getPath(), True)
                out.append(f"{table}/{name}")
    fs, folder = _fs(spark, f"{path}/generations")
    for x in list(fs.listStatus(folder)) if fs.exists(folder) else []:
        if x.getPath().getName() != f"{state.number:012}.json":
            fs.delete(x.getPath(), False)
    return out
