"""Direction axis, unary and pairwise scores, and the joint choice of places per event.

The beam runs in tasks that hold their events in order: one shuffle by event, array arithmetic over
many events per batch, and pairs of candidates exist only there. Candidates of a mention are scored in slices with a
running best, so a name with any number of places fits. Where many mentions have the same candidates, these stay in files
that the tasks read, and only the names that events ask for are shuffled.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from georeport.functions.geo import RADIUS_KM, haversine_km, unit_lat, unit_lon
from georeport.operators.common import let, scratch_path, written
from georeport.operators.spatial import closest_on_lines
from georeport.params import Params, Scoring

# ------------------------------------------------------------ direction axis


def direction_axes(anchors: DataFrame, segments: DataFrame) -> DataFrame:
    """Axis from an anchor (lat, lon) toward the closest line point, as a unit vector in degrees."""
    near = closest_on_lines(anchors, segments)
    dlat, dlon = F.col("line_lat") - F.col("lat"), F.col("line_lon") - F.col("lon")
    return (near.withColumn("axis_dlat", unit_lat(dlat, dlon)).withColumn("axis_dlon", unit_lon(dlat, dlon))
            .drop("line_lat", "line_lon", "line_km")
            .withColumnRenamed("lat", "axis_lat").withColumnRenamed("lon", "axis_lon"))


def _offsets(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    north = haversine_km(lat0, lon0, lat, lon0)
    east = haversine_km(lat0, lon0, lat0, lon)
    return F.when(lat < lat0, -north).otherwise(north), F.when(lon < lon0, -east).otherwise(east)


def along_km(lat: Column, lon: Column, lat0: Column, lon0: Column, vlat: Column, vlon: Column) -> Column:
    north, east = _offsets(lat, lon, lat0, lon0)
    return north * vlat + east * vlon


def cross_km(lat: Column, lon: Column, lat0: Column, lon0: Column, vlat: Column, vlon: Column) -> Column:
    north, east = _offsets(lat, lon, lat0, lon0)
    along = north * vlat + east * vlon
    return F.sqrt(F.pow(north - along * vlat, 2) + F.pow(east - along * vlon, 2))


def project_on_axis(candidates: DataFrame) -> DataFrame:
    """Add ``dir_along_km`` and ``dir_cross_km``; null without an axis."""
    args = [F.col(c) for c in ("lat", "lon", "axis_lat", "axis_lon", "axis_dlat", "axis_dlon")]
    return candidates.withColumn("dir_along_km", along_km(*args)).withColumn("dir_cross_km", cross_km(*args))


def direction_bonus(cross: Column) -> Column:
    return (F.when(cross < 5, F.lit(0.30)).when(cross < 10, F.lit(0.15)).when(cross < 20, F.lit(0.05))
            .when(cross.isNotNull(), F.lit(-0.05)))


# -------------------------------------------------------------------- scores


def unary_score(line_km: Column, cross: Column, along: Column, s: Scoring = Scoring()) -> Column:
    front = F.when(line_km.isNotNull(), s.frontline_weight * F.greatest(F.lit(0.0), 50.0 - line_km) / 50.0).otherwise(0.0)
    lateral = (F.when(cross <= 8, F.lit(1.0)).when(cross <= 20, 1.0 - (cross - 8) / 12.0)
               .otherwise(-F.least((cross - 20) / 20.0, F.lit(1.0))))
    ahead = F.when((along < -10) | (along > 60), F.lit(0.3)).otherwise(1.0)
    return front + F.when(cross.isNotNull(), s.direction_weight * lateral * ahead).otherwise(0.0)


def pair_score(a: Column, b: Column, s: Scoring = Scoring()) -> Column:
    """Coherence of two candidates: structs of ``PAIR_FIELDS``.

    Runs once per extension of the beam, inside array functions, so the angles come ready
    and no term is written twice.
    """
    def coherence(field: str, same: float, differ: float) -> Column:
        return F.when(a[field] == b[field], F.lit(same)).when(a[field] != b[field], F.lit(-differ)).otherwise(0.0)

    def compact(d: Column) -> Column:
        return (F.when(d <= s.close_km, F.lit(1.0))
                .when(d <= s.far_km, (s.far_km - d) / (s.far_km - s.close_km))
                .otherwise(F.greatest((s.far_km - d) / s.far_km, F.lit(-1.0))))

    north = let(F.sin((a["rlat"] - b["rlat"]) / 2), lambda x: x * x)
    east = let(F.sin((a["rlon"] - b["rlon"]) / 2), lambda x: x * x)
    half = F.asin(F.least(F.lit(1.0), F.sqrt(north + a["clat"] * b["clat"] * east)))
    return (coherence("region", s.region_same, s.region_differ) + coherence("grp", s.group_same, s.group_differ)
            + s.compactness_weight * let(half * (2 * RADIUS_KM), compact))


PAIR_FIELDS = ("rlat", "rlon", "clat", "region", "grp")


def with_angles(candidates: DataFrame) -> DataFrame:
    """Add what ``pair_score`` reads; empty region and group names become null."""
    return (candidates.withColumn("rlat", F.radians("lat")).withColumn("rlon", F.radians("lon")).withColumn("clat", F.cos(F.radians("lat")))
            .withColumn("region", F.nullif(F.col("region"), F.lit(""))).withColumn("grp", F.nullif(F.col("grp"), F.lit(""))))


def _sum(items: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + value(x))


def assignment_score(picks: Column, s: Scoring = Scoring()) -> Column:
    """Unary scores plus pairwise scores of all pairs of an assignment."""
    def pairs(ps: Column) -> Column:
        each = F.transform(ps, lambda p, i: _sum(F.slice(ps, 1, i), lambda q: pair_score(p, q, s)))
        return _sum(each, lambda x: x)

    return _sum(picks, lambda p: p["unary"]) + let(picks, pairs)


def confidences(picks: Column, s: Scoring = Scoring()) -> Column:
    """Unary score plus pairwise scores with all other chosen places, per pick. Not bounded by 1."""
    return let(picks, lambda ps: F.transform(ps, lambda p: p["unary"] + _sum(
        F.filter(ps, lambda q: q["loc_no"] != p["loc_no"]), lambda q: pair_score(p, q, s))))


# --------------------------------------------------------------- beam search

_PICK = ("loc_no", "row_no", "cid", "lat", "lon", "rlat", "rlon", "clat", "region", "grp", "qid", "unary")


def _fields(df: DataFrame) -> list[str]:
    """What is kept of a chosen place; its name, too, where candidates have it."""
    return [*_PICK, *(c for c in ("name",) if c in df.columns)]


def _pick(df: DataFrame) -> tuple[Column, str]:
    kinds, fields = dict(df.dtypes), _fields(df)
    return F.struct(*fields), "struct<" + ",".join(f"{c}:{kinds[c]}" for c in fields) + ">"


def _ordered(candidates: DataFrame) -> DataFrame:
    """Order of a candidate within its mention: by distance to a proximity anchor, then gazetteer row."""
    prox = F.coalesce("prox_km", F.lit(0.0)) if "prox_km" in candidates.columns else F.lit(0.0)
    return candidates.withColumn("_prox", prox)


class _Rows:
    """Candidate rows as arrays, for pair scores of many index pairs at once."""

    def __init__(self, table: pa.Table, s: Scoring):
        self._set([*(table[c].to_numpy() for c in ("rlat", "rlon", "clat", "unary")), *(self._codes(table[c]) for c in ("region", "grp"))], s)

    def _set(self, columns: list[np.ndarray], s: Scoring) -> None:
        self.s = s
        self.lat, self.lon, self.cos, self.unary, region, grp = columns
        self.names = [(region, s.region_same, s.region_differ), (grp, s.group_same, s.group_differ)]

    @classmethod
    def of(cls, columns: list[np.ndarray], s: Scoring) -> _Rows:
        """From angles, unary scores and the codes of regions and groups."""
        out = cls.__new__(cls)
        out._set(columns, s)
        return out

    @staticmethod
    def _codes(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)

    def pairs(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Pair scores of rows ``p`` and ``q``, arrays that numpy makes as wide as each other."""
        s = self.s
        dlat, dlon, cos = self.lat[p] - self.lat[q], self.lon[p] - self.lon[q], self.cos[p] * self.cos[q]
        # Most pairs are so far apart that compactness is -1; a band and a strip tell these without angles. Missing coordinates are no such pair.
        most = max(2 * s.far_km, s.close_km) * (1 + 1e-6)
        strip = (np.pi * np.sin(min(most / (2 * RADIUS_KM), np.pi / 2))) ** 2
        at = np.nonzero(~(((np.abs(dlat) > most / RADIUS_KM) | (cos * dlon * dlon > strip)) & (np.abs(dlon) <= np.pi)))
        north, east = np.sin(dlat[at] / 2), np.sin(dlon[at] / 2)
        d = 2 * RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(north * north + cos[at] * east * east)))
        near = np.full(dlat.shape, -1.0)
        near[at] = np.where(d <= s.close_km, 1.0, np.where(
            d <= s.far_km, (s.far_km - d) / (s.far_km - s.close_km), np.maximum((s.far_km - d) / s.far_km, -1.0)))
        total = s.compactness_weight * near
        for codes, same, differ in self.names:
            a, b = codes[p], codes[q]
            total = total + np.where((a < 0) | (b < 0), 0.0, np.where(a == b, same, -differ))
        return total


#: Candidates that are scored against the beam at once, and pairs of places per step.
SLICE, PAIRS = 4096, 1 << 18


class _Search:
    """Beam over the mentions of one event whose candidates come in slices.

    ``picks`` holds rows of the table at hand, a line per partial assignment. Of the open mention, only the best ``width`` extensions so far
    are kept: score, assignment, candidate and its number within the mention.
    """

    def __init__(self, width: int):
        self.width, self.score, self.picks = width, np.zeros(1), np.zeros((1, 0), np.int64)
        self.open: tuple[np.ndarray, ...] | None = None
        self.seen = 0

    def offer(self, rows: _Rows, cands: np.ndarray) -> None:
        for a in range(0, len(cands), SLICE):
            part = cands[a:a + SLICE]
            grown = self.score[:, None] + rows.unary[part][None, :]
            step = max(1, PAIRS // grown.size)
            for k in range(0, self.picks.shape[1], step):
                total = 0.0
                for column in self.picks[:, k:k + step].T:
                    # Assignments share places, so each place is scored once.
                    own, of = np.unique(column, return_inverse=True)
                    total = total + rows.pairs(own[:, None], part[None, :])[of]
                grown = grown + total
            flat = grown.ravel()
            # A stable sort keeps the earlier assignment, then the earlier candidate, on ties; only what reaches the beam is sorted.
            worth, some = -np.round(flat, 9), np.arange(flat.size)
            if flat.size > 4 * self.width:
                some = np.flatnonzero(~(worth > np.partition(worth, self.width - 1)[self.width - 1]))
            best = some[np.argsort(worth[some], kind="stable")[:self.width]]
            new = flat[best], best // len(part), part[best % len(part)], best % len(part) + self.seen
            self.seen += len(part)
            if self.open is not None:
                both = [np.concatenate(x) for x in zip(self.open, new)]
                order = np.lexsort((both[3], both[1], -np.round(both[0], 9)))[:self.width]
                new = tuple(x[order] for x in both)
            self.open = new

    def close(self) -> None:
        """The open mention is whole: its extensions become the assignments."""
        if self.open is not None:
            self.score, parent, cand, _ = self.open
            self.picks = np.hstack([self.picks[parent], cand[:, None]])
            self.open, self.seen = None, 0

    def held(self) -> np.ndarray:
        """Rows that are still needed."""
        return np.unique(np.concatenate([self.picks.ravel(), self.open[2] if self.open is not None else np.zeros(0, np.int64)]))

    def moved(self, rows: np.ndarray) -> None:
        """The table now begins with ``rows`` and holds none before."""
        self.picks = np.searchsorted(rows, self.picks)
        if self.open is not None:
            self.open = (*self.open[:2], np.searchsorted(rows, self.open[2]), self.open[3])


def _tasks(df: DataFrame) -> int:
    """For rows that are few but costly: their bytes must not decide the number of tasks."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _batched_beam(candidates: DataFrame, width: int, s: Scoring) -> DataFrame:
    """One shuffle by event; each task runs over its rows in order, many events per batch.

    A task holds a batch, and of an event that goes on in the next one only the rows of its beam, so neither the places of
    a name nor those of an event have to fit in memory. Mentions with one candidate come first.
    """
    tasks = _tasks(candidates)
    fields = _fields(candidates)
    # Angles are taken behind the shuffle.
    rows = candidates.select("event_id", "_prox", *(c for c in fields if c not in ("rlat", "rlon", "clat"))).repartition(tasks, "event_id")
    many = F.count("*").over(W.partitionBy("event_id", "loc_no")) > 1
    rows = rows.withColumn("_many", many).sortWithinPartitions("event_id", "_many", "loc_no", "_prox", "row_no")
    rows = with_angles(rows).select("event_id", *fields)
    _, kind = _pick(rows)
    schema = f"event_id {dict(candidates.dtypes)['event_id']}, score double, picks array<{kind}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, event, mention, carry = None, None, None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            before = 0 if carry is None else len(carry)
            if carry is not None:
                table = pa.concat_tables([carry, table])
            table = table.combine_chunks()
            every, loc, ids = _Rows(table, s), table["loc_no"].to_numpy(), table["event_id"]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.asarray(pc.not_equal(ids.slice(before + 1), ids.slice(before, batch.num_rows - 1))) | (loc[before + 1:] != loc[before:-1])
            starts = np.append(np.flatnonzero(new), batch.num_rows) + before
            done: list[tuple] = []

            def finish() -> None:
                search.close()
                done.append((event, float(search.score[0]), search.picks[0]))

            for a, b, own in zip(starts[:-1], starts[1:], ids.take(pa.array(starts[:-1])).to_pylist()):
                if own != event:
                    if search is not None:
                        finish()
                    search, event, mention = _Search(width), own, loc[a]
                elif loc[a] != mention:
                    search.close()
                    mention = loc[a]
                search.offer(every, np.arange(a, b))
            if done:
                yield _told(table, done, fields)
            held = search.held()
            search.moved(held)
            carry = table.take(pa.array(held))
        if search is not None:
            search.close()
            yield _told(carry.combine_chunks(), [(event, float(search.score[0]), search.picks[0])], fields)

    return rows.mapInArrow(run, schema)


def _told(table: pa.Table, done: list[tuple], fields: list[str]) -> pa.RecordBatch:
    flat, ends = pa.array(np.concatenate([d[2] for d in done])), np.concatenate([[0], np.cumsum([len(d[2]) for d in done])])
    items = pa.StructArray.from_arrays([table[c].take(flat).combine_chunks() for c in fields], fields)
    return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], table["event_id"].type), pa.array([d[1] for d in done], pa.float64()),
                                       pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], ["event_id", "score", "picks"])


# ------------------------------------------------------- beam over names

#: Rows of a batch on the shelf, batches that a task keeps at hand, assignments told at once, and mentions that events may have in common.
BATCH, AT_HAND, TOLD, BEGINNING = 4096, 64, 512, 8


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)


def _shelved(places: DataFrame, fields: list[str], folder: str) -> DataFrame:
    """Places in Arrow files in ``folder``: of each ``want`` its ``file``, first row ``start`` and number of rows ``n``.

    The places of a want lie together, in the order of candidates. All batches of a file but the last have ``BATCH`` rows, so a
    row's number tells its batch. Each attempt of a task writes a file of its own; only those that count are named.
    """
    tasks = max(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), places.sparkSession.sparkContext.defaultParallelism)
    rows = places.repartition(tasks, "want").sortWithinPartitions("want", "_prox", "row_no")
    rows = with_angles(rows).select("want", *fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        name, out, writer, rest, seen, want, start = uuid.uuid4().hex, None, None, None, 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            body = pa.Table.from_batches([batch.select(fields)])
            if writer is None:
                out = files.open_output_stream(f"{root}/{name}")
                writer, rest = pa.ipc.new_file(out, body.schema), body.slice(0, 0)
            ids = batch.column("want")
            new = np.append(0, np.flatnonzero(np.asarray(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)))) + 1)
            firsts = ids.take(pa.array(new)).to_pylist()
            ended = []
            for at, own in zip(new + seen, firsts):
                if own != want:
                    if at:
                        ended.append((want, start, int(at) - start))
                    want, start = own, int(at)
            seen += batch.num_rows
            rest = pa.concat_tables([rest, body]).combine_chunks()
            whole = rest.num_rows // BATCH * BATCH
            writer.write_table(rest.slice(0, whole), max_chunksize=BATCH)
            rest = rest.slice(whole)
            if ended:
                yield told(name, ended)
        if writer is not None:
            if rest.num_rows:
                writer.write_table(rest.combine_chunks(), max_chunksize=BATCH)
            writer.close()
            out.close()
            yield told(name, [(want, start, seen - start)])

    def told(name: str, ended: list[tuple]) -> pa.RecordBatch:
        wants, starts, sizes = zip(*ended)
        return pa.RecordBatch.from_arrays([pa.array(wants, pa.string()), pa.array([name] * len(ended)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                                          ["want", "file", "start", "n"])

    return written(rows.mapInArrow(run, "want string, file string, start long, n long"), "shelf-index")


class _Shelf:
    """Reads what ``_shelved`` wrote; keeps the batches used last."""

    def __init__(self, folder: str):
        self.files, self.root = _files(folder)
        self.readers: dict[str, pa.ipc.RecordBatchFileReader] = {}
        self.names: dict[str | None, int] = {None: -1}
        self.kept: OrderedDict[tuple[str, int], tuple[pa.RecordBatch, list[np.ndarray]]] = OrderedDict()

    def _codes(self, column: pa.Array) -> np.ndarray:
        coded = column.dictionary_encode()
        # Null is the last one, which -1 finds.
        codes = np.array([*(self.names.setdefault(x, len(self.names)) for x in coded.dictionary.to_pylist()), -1])
        return codes[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)]

    def batch(self, file: str, no: int) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        """A batch and what the search reads of it, see ``_Rows.of``."""
        key = file, no
        if key in self.kept:
            self.kept.move_to_end(key)
        else:
            if file not in self.readers:
                self.readers[file] = pa.ipc.open_file(self.files.open_input_file(f"{self.root}/{file}"))
            rows = self.readers[file].get_batch(no)
            self.kept[key] = rows, [*(rows.column(c).to_numpy(zero_copy_only=False) for c in ("rlat", "rlon", "clat", "unary")), *(self._codes(rows.column(c)) for c in ("region", "grp"))]
            if len(self.kept) > AT_HAND:
                self.kept.popitem(last=False)
        return self.kept[key]

    def parts(self, file: str, start: int, n: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """Places of a want, batch by batch: what the search reads of them, and the numbers of their rows."""
        while n:
            no, at = divmod(start, BATCH)
            size = min(n, BATCH - at)
            yield [c[at:at + size] for c in self.batch(file, no)[1]], np.arange(start, start + size)
            start, n = start + size, n - size

    def row(self, file: str, row: int) -> pa.RecordBatch:
        return self.batch(file, row // BATCH)[0].take(pa.array([row % BATCH]))


class _State:
    """Assignments of an event's first mentions: the search, its places, and of each place the file and row."""

    def __init__(self, search: _Search, places: list[np.ndarray], at: np.ndarray):
        self.search, self.places, self.at = search, places, at

    def grown(self, file_no: int, file: str, start: int, n: int, shelf: _Shelf, s: Scoring) -> _State:
        """The next mention's places tried; the state itself stays."""
        search = _Search(self.search.width)
        search.score, search.picks = self.search.score, self.search.picks
        places, at = self.places, self.at
        for more, rows in shelf.parts(file, start, n):
            held = len(at)
            places = [np.concatenate(x) for x in zip(places, more)]
            at = np.concatenate([at, np.stack([np.full(len(rows), file_no), rows], 1)])
            search.offer(_Rows.of(places, s), np.arange(held, len(at)))
            kept = search.held()
            search.moved(kept)
            places, at = [c[kept] for c in places], at[kept]
        search.close()
        return _State(search, places, at)


def _beam_of_wants(asked: DataFrame, places: DataFrame, width: int, s: Scoring) -> DataFrame:
    """The beam where candidates are ``asked`` (event_id, loc_no, want) joined with ``places`` by ``want``.

    That join is not made: places lie in files of the shared folder, and each task reads those of the names at hand. Events are dealt in the
    order of what they ask for, and where the next one begins with the same names, the search goes on from there.
    """
    ordered = _ordered(places)
    fields = [c for c in _fields(ordered.withColumn("loc_no", F.lit(0))) if c != "loc_no"]
    folder = scratch_path(asked.sparkSession, "shelf")
    index = _shelved(ordered, fields, folder)
    many = F.col("n") > 1
    # The mentions in the order of the search: those with one place first.
    lists = (asked.select("event_id", "loc_no", "want").join(index, "want").groupBy("event_id")
             .agg(F.array_sort(F.collect_list(F.struct(many.alias("many"), "loc_no", "file", "start", "n"))).alias("asks")))
    first = F.transform("asks", lambda a: F.concat_ws("/", a["file"], F.format_string("%012d", a["start"])))
    lists = written(lists.withColumn("_order", F.array_join(first, " ")), "wanted-lists")
    lists = lists.filter("event_id is not null").repartitionByRange(_tasks(asked), "_order").sortWithinPartitions("_order").select("event_id", "asks")
    kinds = dict(asked.dtypes) | dict(places.select(*(c for c in fields if c in places.columns)).dtypes) | dict(with_angles(ordered.limit(0)).select("rlat", "rlon", "clat", "region", "grp").dtypes)
    names = ["loc_no", *fields]
    schema = f"event_id {kinds['event_id']}, score double, picks array<struct<{','.join(f'{c}:{kinds[c]}' for c in names)}>>"
    loc_type = StructType.fromDDL(f"loc_no {kinds['loc_no']}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, loc = _Shelf(folder), to_arrow_schema(loc_type).field(0).type
        none = [*(np.zeros(0) for _ in range(4)), *(np.zeros(0, np.int64) for _ in range(2))]
        empty = _State(_Search(width), none, np.zeros((0, 2), np.int64))
        numbers: dict[str, int] = {}
        files: list[str] = []
        trail: list[tuple[tuple, _State]] = []

        def tell(done: list[tuple]) -> pa.RecordBatch:
            table = pa.Table.from_batches([shelf.row(files[f], r) for _, _, _, at in done for f, r in at.tolist()])
            columns = [pa.array([x for _, locs, _, _ in done for x in locs], loc), *(table[c].combine_chunks() for c in fields)]
            ends = np.cumsum([0, *(len(locs) for _, locs, _, _ in done)])
            items = pa.StructArray.from_arrays(columns, names)
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.schema.field(0).type), pa.array([d[2] for d in done], pa.float64()),
                                               pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], ["event_id", "score", "picks"])

        for batch in batches:
            done = []
            for event, asks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                wants = [(a["file"], a["start"], a["n"]) for a in asks]
                same = 0
                while same < min(len(wants), len(trail)) and trail[same][0] == wants[same]:
                    same += 1
                del trail[same:]
                best = trail[-1][1] if trail else empty
                for want in wants[same:]:
                    if want[0] not in numbers:
                        numbers[want[0]] = len(files)
                        files.append(want[0])
                    best = best.grown(numbers[want[0]], *want, shelf, s)
                    if len(trail) < BEGINNING:
                        trail.append((want, best))
                done.append((event, [a["loc_no"] for a in asks], float(best.search.score[0]), best.at[best.search.picks[0]]))
                if len(done) >= TOLD:
                    yield tell(done)
                    done = []
            if done:
                yield tell(done)

    return lists.mapInArrow(run, schema)


def choose_places(candidates: DataFrame, params: Params = Params(), sides: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Best joint assignment per event: ``event_id``, ``score``, ``picks``.

    ``candidates``: event_id, loc_no, row_no, cid, lat, lon, region, grp, qid, unary and
    optionally prox_km. Mentions with one candidate are fixed first, the others follow in order. ``sides``: the mentions (event_id,
    loc_no, want) and the places (want and the rest) whose join by ``want`` the candidates are, if they are; it is then not carried out.
    """
    if sides is not None:
        return _beam_of_wants(*sides, params.beam_width, params.scoring)
    return _batched_beam(_ordered(candidates), params.beam_width, params.scoring)


def choose_wanted(mentioned: DataFrame, places: DataFrame, params: Params = Params()) -> DataFrame:
    """``choose_places`` where mentions that ask for the same, ``want`` (see ``context.asked_once``), have the same candidates.

    ``mentioned``: event_id, loc_no, want; ``places``: want and the columns of candidates but event_id and loc_no. Events that ask for the
    same in the same order have the same assignment: the first of them is searched, and the others get its places at their own loc_no.
    """
    asks = F.array_sort(F.collect_list(F.struct("loc_no", F.coalesce("want", F.lit("")).alias("want"))))
    lists = mentioned.groupBy("event_id").agg(asks.alias("_l"))
    # Wants are JSON, which has no line ends.
    lists = written(lists.select("event_id", F.transform("_l", lambda x: x["loc_no"]).alias("_locs"),
                                 F.array_join(F.transform("_l", lambda x: x["want"]), "\n").alias("_asks")), "asked-lists")
    first = lists.groupBy("_asks").agg(F.min("event_id").alias("_first"))
    searched = first.select(F.col("_first").alias("event_id"), F.posexplode(F.split("_asks", "\n")).alias("loc_no", "want"))
    chosen = choose_places(searched.join(places, "want").drop("want"), params, (searched, places)).withColumnRenamed("event_id", "_first")
    own = F.transform("picks", lambda p: p.withField("loc_no", F.get("_locs", p["loc_no"])))
    # Assignments are few bytes, but what follows compares their places in pairs.
    return lists.join(first.join(chosen, "_first"), "_asks").select("event_id", "score", own.alias("picks")).repartition(_tasks(lists), "event_id")


# ---------------------------------------------------------------- diagnostics


def bbox_km(picks: Column) -> Column:
    lats, lons = F.transform(picks, lambda p: p["lat"]), F.transform(picks, lambda p: p["lon"])
    return F.when(F.size(picks) == 0, F.lit(0.0)).otherwise(
        haversine_km(F.array_min(lats), F.array_min(lons), F.array_max(lats), F.array_max(lons)))


def centroid(picks: Column) -> Column:
    n = F.greatest(F.size(picks), F.lit(1))
    return F.struct((_sum(picks, lambda p: p["lat"]) / n).alias("lat"), (_sum(picks, lambda p: p["lon"]) / n).alias("lon"))


def _median(values: Column) -> Column:
    """Median of an array that is in order; 0 when it is empty."""
    n = F.size(values)
    mid = (n / 2).cast("int")
    return (F.when(n == 0, F.lit(0.0)).when(n % 2 == 1, F.get(values, mid))
            .otherwise((F.get(values, mid - 1) + F.get(values, mid)) / 2))


def _pair_km(picks: Column) -> Column:
    """Distances of all pairs in order, with their two locations."""
    return F.sort_array(F.flatten(F.transform(picks, lambda a, i: F.transform(F.slice(picks, 1, i), lambda b: F.struct(
        haversine_km(b["lat"], b["lon"], a["lat"], a["lon"]).alias("km"), b["loc_no"].alias("a"), a["loc_no"].alias("b"))))))


def median_pair_km(picks: Column) -> Column:
    return let(let(picks, lambda ps: F.transform(_pair_km(ps), lambda x: x["km"])), _median)


def outliers(picks: Column, limit_km: float) -> Column:
    """Locations farther than the limit from the centroid."""
    far = let(centroid(picks), lambda c: F.filter(picks, lambda p: haversine_km(p["lat"], p["lon"], c["lat"], c["lon"]) > limit_km))
    return F.transform(far, lambda p: p["loc_no"])


def duplicate_qids(picks: Column) -> Column:
    """Qids chosen for several locations, with these locations."""
    def of(ps: Column) -> Column:
        qids = F.array_sort(F.array_distinct(F.filter(F.transform(ps, lambda p: p["qid"]), lambda q: F.coalesce(q, F.lit("")) != "")))
        groups = F.transform(qids, lambda q: F.struct(q.alias("qid"), F.array_sort(F.transform(
            F.filter(ps, lambda p: p["qid"] == q), lambda p: p["loc_no"])).alias("loc_nos")))
        return F.filter(groups, lambda g: F.size(g["loc_nos"]) > 1)

    return let(picks, of)


def structural_outliers(picks: Column) -> Column:
    """Locations whose removal tightens the median pair distance by over 5 km and over 35 %."""
    def judge(v: Column) -> Column:
        def loose(p: Column) -> Column:
            rest = F.filter(v["pairs"], lambda x: (x["a"] != p["loc_no"]) & (x["b"] != p["loc_no"]))
            return let(F.struct(v["base"].alias("b"), let(F.transform(rest, lambda x: x["km"]), _median).alias("m")),
                       lambda g: (g["b"] - g["m"] > 5.0) & ((g["b"] - g["m"]) / g["b"] > 0.35))

        return F.transform(F.filter(v["ps"], lambda p: (F.size(v["ps"]) > 2) & (v["base"] > 0) & loose(p)), lambda p: p["loc_no"])

    pairs = let(picks, lambda ps: F.struct(ps.alias("ps"), _pair_km(ps).alias("pairs")))
    based = let(pairs, lambda v: v.withField("base", let(F.transform(v["pairs"], lambda x: x["km"]), _median)))
    return let(based, judge)


def diagnostics(chosen: DataFrame, params: Params = Params()) -> DataFrame:
    p = F.col("picks")
    return chosen.select(
        "event_id", bbox_km(p).alias("bbox_km"), (bbox_km(p) > params.max_bbox_km).alias("bbox_is_large"),
        outliers(p, params.max_bbox_km).alias("outliers"), duplicate_qids(p).alias("duplicate_qids"),
        structural_outliers(p).alias("structural_outliers"))


def assignments(chosen: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per resolved mention with its place and confidence."""
    pairs = F.arrays_zip(F.col("picks").alias("p"), confidences(F.col("picks"), params.scoring).alias("c"))
    named = ["x.p.name"] if "name" in chosen.schema["picks"].dataType.elementType.names else []
    return chosen.select("event_id", F.explode(pairs).alias("x")).select(
        "event_id", "x.p.loc_no", "x.p.cid", "x.p.row_no", "x.p.lat", "x.p.lon", "x.p.region", "x.p.grp", *named, F.col("x.c").alias("confidence"))


def write_back(mentions: DataFrame, chosen: DataFrame, locales: DataFrame, params: Params = Params()) -> DataFrame:
    """Every mention with its final place; those without candidates stay unresolved."""
    final = assignments(chosen, params)
    if "name" not in final.columns:
        final = final.join(locales.select("row_no", "name"), "row_no")
    final = final.select(
        "event_id", "loc_no", F.col("cid").alias("final_cid"), F.col("name").alias("final_name"), F.col("lat").alias("final_lat"),
        F.col("lon").alias("final_lon"), F.col("region").alias("final_region"), F.col("grp").alias("final_group"),
        F.col("confidence").alias("final_confidence"))
    return mentions.join(final, ["event_id", "loc_no"], "left")
