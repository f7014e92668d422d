"""Order-dependent clustering, exact and in parallel.

Each step places transcripts one by one into clusters seeded by earlier ones,
so no join can express it. Seeds accept only what is near, so islands are
independent of each other: every group of islands runs in one Arrow-fed Python
task, and the results equal those over the whole genome. Equal structures are
decided once: a transcript like an earlier one goes where that one went, unless
that one founded a cluster that refuses it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isolume.config import STATUS_PRIORITY, ClusterConfig, MergeConfig
from isolume.operators.interval import transcript_islands

#: seed is the ord of the transcript that founded the cluster; status is the pair's.
PLACED = "ord bigint, seed bigint, status string"


def nearest(ja: list, jb: list, limit: int) -> list[tuple[int, int, int]]:
    """(i, j, error) of a greedy matching: each junction of ja takes the nearest free one of jb, ties to the first.

    Donors of jb that rise, as they nearly always do, are searched; others are gone through.
    """
    taken, out, n = set(), [], len(jb)
    donors = [y[0] for y in jb]
    rising = all(x <= y for x, y in zip(donors, donors[1:], strict=False))
    for i, (d, a, s) in enumerate(ja):
        best = None
        j = bisect_left(donors, d - limit) if rising else 0
        while j < n:
            e, b, t = jb[j]
            if rising and e > d + limit:
                break
            if j not in taken and (s == t or s == "." or t == "."):
                error = max(abs(d - e), abs(a - b))
                if error <= limit and (best is None or error < best[0]):
                    best = error, j
            j += 1
        if best:
            taken.add(best[1])
            out.append((i, best[1], best[0]))
    return out


def _gapless(xs: list[int]) -> bool:
    return all(y - x == 1 for x, y in zip(xs, xs[1:], strict=False))


def _ends(t: dict) -> tuple[int, int]:
    return (t["end"], t["start"]) if t["strand"] == "-" else (t["start"], t["end"])


def multi_status(seed: dict, t: dict, cfg: MergeConfig) -> str | None:
    """Status of a multi-exon pair of one chromosome, or None if it can't be merged. Far ends are refused before junctions are matched."""
    (tss_a, tes_a), (tss_b, tes_b) = _ends(seed), _ends(t)
    if abs(tss_a - tss_b) > cfg.tss_window or abs(tes_a - tes_b) > cfg.tes_window:
        return None
    links = nearest(seed["j"], t["j"], cfg.junction_threshold)
    if not links:
        return None
    xs, ys = [x for x, _, _ in links], [y for _, y, _ in links]
    if not (_gapless(xs) and _gapless(ys)):
        return None
    lost = [max(xs[0], ys[0]), max(len(seed["j"]) - 1 - xs[-1], len(t["j"]) - 1 - ys[-1])]
    if cfg.strand_aware_trunc and seed["strand"] == "-":
        lost.reverse()
    if lost[0] > cfg.max_5trunc and not (cfg.unlimited_5trunc and cfg.max_5trunc < 0):
        return None
    if 0 <= cfg.max_3trunc < lost[1]:
        return None
    moved = sum(e > 0 for _, _, e in links)
    if 0 <= cfg.max_diff_count < moved or moved / len(links) > cfg.max_diff_ratio:
        return None
    return {(False, False): "fuzzy_match" if moved else "exact_match", (True, False): "truncation_5", (False, True): "truncation_3", (True, True): "truncation_both"}[lost[0] > 0, lost[1] > 0]


def mono_status(seed: dict, t: dict, cfg: MergeConfig) -> str | None:
    """Status of a mono-exon pair, or None."""
    (a, b), (c, d) = seed["x"][0][:2], t["x"][0][:2]
    shorter = min(b - a, d - c)
    if shorter == 0 or max(0, min(b, d) - max(a, c)) / shorter < cfg.mono_overlap:
        return None
    ends = [abs(a - c), abs(b - d)]
    five, three = {"+": ends, "-": ends[::-1]}.get(seed["strand"], sorted(ends, reverse=True))
    if five > cfg.mono_5end or three > cfg.mono_3end:
        return None
    return "monoexon_overlap" if any(ends) else "monoexon_exact"


def first_fit(items: list[dict], accept: Callable[[dict, dict], str | None], at: Callable[[dict], int], reach: int) -> list[tuple[int, int, str | None]]:
    """(ord, seed, status) of each item in turn: it joins the first cluster whose seed accepts it, else founds one.

    A seed accepts only items whose place `at` is within reach of its own, so seeds are kept by stretches of that width.
    """
    seeds: list[dict] = []
    near: dict[int, list[int]] = {}
    went: dict[tuple, int] = {}
    out = []
    width = max(reach, 1)
    for t in items:
        stretch, since = at(t) // width, went.get(t["key"], 0)
        status, k = None, len(seeds)
        for i in sorted(i for s in (stretch - 1, stretch, stretch + 1) for i in near.get(s, ()) if i >= since):
            status = accept(seeds[i], t)
            if status is not None:
                k = i
                break
        if k == len(seeds):
            seeds.append(t)
            near.setdefault(stretch, []).append(k)
        went[t["key"]] = k
        out.append((t["ord"], seeds[k]["ord"], status))
    return out


def _triples(column: pa.Array | pa.ChunkedArray, fields: tuple[str, str]) -> list[list[tuple]]:
    """Lists of (first field, second field, strand) of a column of lists of structs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    told = list(zip(*[flat.field(f).to_pylist() for f in (*fields, "strand")], strict=True))
    out, at = [], 0
    for n in column.value_lengths().to_pylist():
        out.append(told[at : at + (n or 0)])
        at += n or 0
    return out


def _rows(batch: pa.Table | pa.RecordBatch) -> list[dict]:
    rows = batch.select([c for c in batch.schema.names if c not in ("exons", "junctions")]).to_pylist()
    for r, x, j in zip(rows, _triples(batch.column("exons"), ("start", "end")), _triples(batch.column("junctions"), ("donor", "acceptor")), strict=True):
        r["x"], r["j"] = x, j
        r["length"] = sum(b - a for a, b, _ in x)
        r["plain"] = all(a[1] <= b[0] for a, b in zip(x, x[1:], strict=False))
        r["key"] = (r["start"], r["end"], tuple(j), tuple(x) if not j else ())
    return rows


def _grouped(t: DataFrame, run: Callable[[list[dict]], list[tuple]], extra: tuple[str, ...] = (), schema: str = PLACED) -> DataFrame:
    """Runs a function over each island; t has the islands.

    Islands are dealt out by their own key (a chromosome's would all meet in one task otherwise) and stream through
    sorted, so a task holds one island at a time.
    """
    fields = [x.split() for x in schema.split(", ")]
    types = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def told(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], types[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        now = None
        for batch in batches:
            found: list[tuple] = []
            for r in _rows(batch):
                island = r["chrom"], r["strand"], r["island"]
                if held and island != now:
                    found += run(held)
                    held = []
                now = island
                held.append(r)
            if found:
                yield told(found)
        if held:
            yield told(run(held))

    key = ("chrom", "strand", "island")
    narrow = t.select(*key, "ord", "start", "end", "exons", "junctions", *extra)
    return narrow.repartition(*key).sortWithinPartitions(*key).mapInArrow(work, schema)


def _multi(rows: list[dict], cfg: MergeConfig) -> list[tuple]:
    """Multi-exon transcripts: more junctions first, then longer ones, then in input order."""
    rows = sorted((r for r in rows if len(r["x"]) > 1), key=lambda r: (-len(r["j"]), -r["length"], r["ord"]))
    return first_fit(rows, lambda seed, r: multi_status(seed, r, cfg), lambda r: _ends(r)[0], cfg.tss_window)


def _mono(rows: list[dict], cfg: MergeConfig) -> list[tuple]:
    """Mono-exon transcripts in order of start."""
    rows = sorted((r for r in rows if len(r["x"]) == 1), key=lambda r: (r["start"], r["ord"]))
    return first_fit(rows, lambda seed, r: mono_status(seed, r, cfg), lambda r: r["x"][0][0], max(cfg.mono_5end, cfg.mono_3end))


def _mono_reach(cfg: MergeConfig) -> int:
    return 0 if cfg.mono_overlap > 0 else max(cfg.mono_5end, cfg.mono_3end)


def merge_mono_exon(t: DataFrame, cfg: MergeConfig) -> DataFrame:
    """(ord, seed, status) of mono-exon transcripts."""
    return _grouped(transcript_islands(t, _mono_reach(cfg)), lambda rows: _mono(rows, cfg))


def place_transcripts(t: DataFrame, cfg: MergeConfig) -> DataFrame:
    """(ord, seed, status) of all transcripts; multi-exon and mono-exon ones never share a cluster, but are found on the same islands."""
    return _grouped(transcript_islands(t, max(cfg.junction_threshold, _mono_reach(cfg))), lambda rows: _multi(rows, cfg) + _mono(rows, cfg))


def merge_clusters(t: DataFrame, cfg: MergeConfig) -> DataFrame:
    """Adds seed, mono and status (of the cluster) to every transcript.

    A cluster of one is a singleton. A multi-exon cluster has the best status of its pairs, of equally good ones the
    first; a mono-exon one is exact if all its pairs are.
    """
    t = t.filter(F.size("exons") > 0).withColumn("mono", F.size("exons") == 1)
    placed = place_transcripts(t, cfg)
    good = F.create_map(*[F.lit(x) for kv in STATUS_PRIORITY.items() for x in kv])
    out = t.join(placed, "ord").withColumn("length", F.aggregate("exons", F.lit(0).cast("bigint"), lambda n, e: n + e["end"] - e["start"]))
    order = F.struct(-F.size("junctions"), -F.col("length"), F.col("ord"))
    best = out.groupBy("seed", "mono").agg(
        F.count(F.lit(1)).alias("members"),
        F.min_by("status", F.when(F.col("status").isNotNull(), F.struct(good[F.col("status")], order))).alias("best"),
        F.max(F.when(F.col("status") == "monoexon_overlap", 1)).alias("moved"),
    )
    of_mono = F.when(F.col("moved") == 1, "monoexon_overlap").otherwise("monoexon_exact")
    status = F.when(F.col("members") == 1, "singleton").when(F.col("mono"), of_mono).otherwise(F.coalesce("best", F.lit("exact_match")))
    best = best.select("seed", "mono", status.alias("cluster_status"))
    return out.drop("status").join(best, ["seed", "mono"]).withColumnRenamed("cluster_status", "status")


def _like(x: int, y: int) -> float:
    return 1.0 - abs(x - y) / max(x, y) if max(x, y) else 0.0


def most_similar(a: dict, b: dict, cfg: ClusterConfig) -> float:
    """An upper bound of the total similarity, from counts alone: at most the fewer junctions and the shorter length are shared.

    Infinite if a transcript's own exons overlap, since bases would count twice.
    """
    if not (a["plain"] and b["plain"]):
        return float("inf")
    ja, jb, la, lb = len(a["j"]), len(b["j"]), a["length"], b["length"]
    parts = [(cfg.weight_structural, _like(len(a["x"]), len(b["x"])) * _like(la, lb)), (cfg.weight_jaccard, _like(la, lb))]
    if ja or jb:
        parts.append((cfg.weight_junction, min(ja, jb) / max(ja, jb)))
    weight = sum(w for w, _ in parts)
    return sum(w / weight * s for w, s in parts) + 1e-3 if weight and min(w for w, _ in parts) >= 0 else float("inf")


def similarity_parts(a: dict, b: dict, cfg: ClusterConfig) -> tuple[float, float, float, float]:
    """(structural, junction, jaccard, total), each rounded to four places as the limits expect."""
    structural = _like(len(a["x"]), len(b["x"])) * _like(a["length"], b["length"])
    shared = sum(max(0, min(e, f) - max(s, t)) for s, e, _ in a["x"] for t, f, _ in b["x"] if s < f and t < e)
    union = a["length"] + b["length"] - shared
    jaccard = shared / union if union else 0.0
    ja, jb = a["j"], b["j"]

    def near(x: tuple, y: tuple, limit: int) -> bool:
        return (x[2] == y[2] or "." in (x[2], y[2])) and max(abs(x[0] - y[0]), abs(x[1] - y[1])) <= limit

    def fit(items: list, used: set, limit: int) -> int:
        """Lets each item take the first free partner; says how many did."""
        n = len(used)
        for x in items:
            k = next((k for k, y in enumerate(jb) if k not in used and near(x, y, limit)), None)
            if k is not None:
                used.add(k)
        return len(used) - n

    if ja and jb:
        used: set[int] = set()
        strict = fit(ja, used, cfg.junction_threshold)
        held = set(used)
        open_ = [x for x in ja if not any(near(x, jb[k], cfg.junction_threshold) for k in held)]
        junction = min((strict + 0.5 * fit(open_, used, cfg.fuzzy_threshold)) / max(len(ja) + len(jb) - strict, 1), 1.0)
    else:
        junction = 0.0 if ja or jb else 1.0
    parts = [(cfg.weight_structural, structural), (cfg.weight_jaccard, jaccard)]
    if ja or jb:
        parts.insert(1, (cfg.weight_junction, junction))
    weight = sum(w for w, _ in parts)
    total = sum(w / weight * s for w, s in parts) if weight else 0.0
    return round(structural, 4), round(junction, 4), round(jaccard, 4), round(total, 4)


MEMBER = "ord bigint, seed bigint, total double, structural double, junction double, jaccard double"


def similarity_clusters(t: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """(ord, seed, total, structural, junction, jaccard): best-fit clustering around representatives.

    t has is_ref and n_occurrences. References come first, then what occurs more often, longer ones, and by ID;
    each joins the overlapping representative that is most like it, if that is at least min_similarity and above
    0 (ties to the older one), else it becomes one itself.
    """

    def run(rows: list[dict]) -> list[tuple]:
        rows.sort(key=lambda r: (not r["is_ref"], -r["n_occurrences"], -r["length"], r["transcript_id"], r["ord"]))
        reps: list[dict] = []
        known: dict[tuple, tuple] = {}
        out = []
        for r in rows:
            best, most, shape = None, (0.0, 0.0, 0.0, 0.0), (r["key"], tuple(r["x"]))
            for rep in reps:
                if rep["start"] < r["end"] and rep["end"] > r["start"]:
                    if most_similar(rep, r, cfg) < max(cfg.min_similarity, most[3]):
                        continue
                    pair = (rep["ord"], shape)
                    if pair not in known:
                        known[pair] = similarity_parts(rep, r, cfg)
                    parts = known[pair]
                    if parts[3] >= cfg.min_similarity and parts[3] > most[3]:
                        best, most = rep, parts
            if best is None:
                reps.append(r)
                out.append((r["ord"], r["ord"], 1.0, 1.0, 1.0, 1.0))
            else:
                out.append((r["ord"], best["ord"], most[3], *most[:3]))
        return out

    return _grouped(transcript_islands(t, 0), run, ("transcript_id", "is_ref", "n_occurrences"), MEMBER)


def iterate(rows: DataFrame) -> Iterator[dict]:
    """Rows as the kernels see them, for tests."""
    yield from _rows(rows.select("ord", "start", "end", "strand", "exons", "junctions").toArrow())
