"""Gaps (D01-D14, D17): notes that are related by their chunks and far apart, or unlinked, in the graph."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.config import RELATIONS, Settings
from knotwork.functions.relations import DIRECTIONS, parsed_relation
from knotwork.functions.text import pair_key, token_estimate
from knotwork.operators import graph as g
from knotwork.operators import relatedness as rel
from knotwork.store import written

#: Tokens of the frame and of the answer of a request.
FRAME_TOKENS, ANSWER_TOKENS = 150, 120


def near_pairs(links: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """Of pairs(a, b), those at most so many hops apart (1 to 5).

    Only from the smaller note of each pair, and only as many walks as there are pairs' notes: both sides grow
    half the way, so a hub is met in the middle instead of being walked through.
    """
    edges = g.neighbours(links)
    if most == 2:
        # both ends at once: the end with fewer links is spelled out, the other one is only looked up
        edges = written(edges, "edges")
        degree = edges.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
        ends = pairs.select("a", "b").join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
        less = F.col("da") <= F.col("db")
        turned = ends.select("a", "b", F.when(less, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("y"))
        steps = turned.join(edges.toDF("x", "at"), "x")
        two = steps.join(edges.toDF("at", "y"), ["at", "y"], "left_semi").select("a", "b")
        return two.unionByName(steps.where(F.col("at") == F.col("y")).select("a", "b")).distinct()
    half = (most + 1) // 2

    def reach(name: str, steps: int) -> DataFrame:
        at = pairs.select(F.col(name).alias("from")).distinct().withColumn("at", F.col("from"))
        out = at
        for _ in range(steps):
            at = at.join(edges, F.col("at") == F.col("u")).select("from", F.col("v").alias("at")).distinct()
            out = out.unionByName(at)
        return out.distinct()

    left, right = reach("a", half).toDF("a", "at"), reach("b", most - half).toDF("b", "at")
    return pairs.select("a", "b").join(left, "a").join(right, ["b", "at"]).select("a", "b").distinct()


def gaps(chunks: DataFrame, graph: g.Graph, inferred: DataFrame | None = None, dismissed: DataFrame | None = None, focus: str | None = None, settings: Settings | None = None, floor: float | None = None, knn: int | None = rel.KNN, dim: int = 64, with_evidence: bool = True, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Scored pairs a < b of related notes that are more than graph_distance_threshold hops apart, have no inferred relation
    and were not dismissed. chunks(id, note, text, vector); inferred(src, dst, ...); dismissed(key); known is rel.related() where it is there already."""
    s = settings or Settings()
    floor = s.cosine_floor if floor is None else floor
    near, weights = known or rel.related(chunks, floor, knn, focus, dim)
    pairs = near.select("a", "b").distinct()
    pairs = pairs.join(near_pairs(graph.links, pairs, max(1, min(5, s.graph_distance_threshold))), ["a", "b"], "left_anti")
    if inferred is not None:
        pairs = pairs.join(g.inferred_pairs(inferred), ["a", "b"], "left_anti")
    if dismissed is not None:
        pairs = pairs.withColumn("key", pair_key("a", "b")).join(dismissed.select("key"), "key", "left_anti").drop("key")
    scored = rel.score_pairs(pairs, chunks, floor, s.reuse_discount, dim, with_evidence, near, weights)
    return scored.where(F.col("final_score") >= s.similarity_threshold)


def _numbered(edges: DataFrame) -> DataFrame:
    """note and n: the notes of edges(u, v), numbered from 0 in their order."""
    lined = edges.select(F.col("u").alias("note")).distinct().repartitionByRange("note").sortWithinPartitions("note")
    rows = written(lined.withColumn("at", F.monotonically_increasing_id()), "numbered")
    part, own = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before, n = {}, 0
    for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect():
        before[r["part"]], n = n, n + r["count"]
    start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0).cast("bigint"), F.lit(0))
    return rows.select("note", (start[part] + own).cast("int").alias("n"))


def _walks(shared, most: int, ways: bool):
    """Distances of pairs(a, b, x, y), x and y the numbers of a and b, and the smallest shortest way: 64 notes x search at once, each a bit of a word for every note."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, to = shared.value
        around = lambda n: to[starts[n] : starts[n + 1]]

        def way(levels: list[np.ndarray], bit: np.uint64, x: int, y: int) -> list[int]:
            back = [np.array([y])]
            for front in reversed(levels[1:-1]):
                near = np.unique(np.concatenate([around(n) for n in back[-1]]))
                back.append(near[(front[near] & bit) != 0])
            out = [x]
            for some in reversed(back):
                out.append(int(np.intersect1d(around(out[-1]), some).min()))
            return out

        for t in batches:
            if not len(t):
                continue
            x, y = t.column("x").to_numpy(), t.column("y").to_numpy()
            hops, found = np.full(len(x), -1, np.int32), [[] for _ in x]
            asked, place = np.unique(x, return_inverse=True)
            for first in range(0, len(asked), 64):
                own = asked[first : first + 64]
                mine = np.flatnonzero((place >= first) & (place < first + 64))
                bits = np.uint64(1) << (place[mine] - first).astype(np.uint64)
                seen = np.zeros(len(starts) - 1, np.uint64)
                seen[own] = np.uint64(1) << np.arange(len(own), dtype=np.uint64)
                levels, open_ = [seen.copy()], np.ones(len(mine), bool)
                for h in range(1, most + 1):
                    front = np.bitwise_or.reduceat(levels[-1][to], starts[:-1]) & ~seen
                    seen |= front
                    levels.append(front)
                    hit = np.flatnonzero(open_ & ((front[y[mine]] & bits) != 0))
                    hops[mine[hit]] = h
                    open_[hit] = False
                    if ways:
                        for k in hit:
                            found[mine[k]] = way(levels, bits[k], int(x[mine[k]]), int(y[mine[k]]))
                    if not open_.any() or not front.any():
                        break
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(hops), pa.array(found, pa.list_(pa.int32()))], ["a", "b", "hops", "way"])

    return run


def enrich(found: DataFrame, links: DataFrame, most: int = 10, ways: bool = True) -> DataFrame:
    """found with hops and bridge_path of each pair (-1 and empty if farther than most; the path empty too without ways).

    The smallest in order of the notes of the shortest ways. The graph goes to all tasks as two arrays of numbers, 4 bytes for each direction of
    a link; 64 notes search in one pass over it, so no rows are made of the notes that are passed.
    """
    edges = written(g.neighbours(links), "edges")
    names = written(_numbered(edges), "names")
    at = lambda c, n: names.select(F.col("note").alias(c), F.col("n").alias(n))
    t = edges.join(at("u", "p"), "u").join(at("v", "q"), "v").select("p", "q").toArrow()
    p, q = (t.column(c).to_numpy() for c in ("p", "q"))
    order = np.lexsort((q, p))
    starts = np.concatenate([[0], np.cumsum(np.bincount(p, minlength=1))]).astype(np.int64)
    sc = found.sparkSession.sparkContext
    shared = sc.broadcast((starts, q[order].astype(np.int32)))
    pairs = found.select("a", "b").distinct().join(at("a", "x"), "a").join(at("b", "y"), "b")
    lined = pairs.repartition(max(8, 2 * sc.defaultParallelism), "x").sortWithinPartitions("x")
    done = written(lined.mapInArrow(_walks(shared, most, ways), "a string, b string, hops int, way array<int>"), "walks")
    shared.destroy()
    steps = done.select("a", "b", F.posexplode("way").alias("k", "n")).join(names, "n").groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("k", "note"))).alias("s"))
    out = found.join(done.select("a", "b", "hops"), ["a", "b"], "left").join(steps.select("a", "b", F.col("s.note").alias("bridge_path")), ["a", "b"], "left") if ways else found.join(done.select("a", "b", "hops"), ["a", "b"], "left").withColumn("bridge_path", F.lit(None))
    return out.withColumn("hops", F.coalesce("hops", F.lit(-1))).withColumn("bridge_path", F.coalesce(F.col("bridge_path").cast("array<string>"), F.array().cast("array<string>")))


class Provider(Protocol):
    name: str

    def classify(self, source_title: str, target_title: str, source_text: str, target_text: str) -> str: ...


class MockProvider:
    """Answers by titles, in either order; NONE with 0.5 otherwise."""

    name = "mock"

    def __init__(self, answers: dict[tuple[str, str], dict] | None = None):
        self.answers = answers or {}

    def classify(self, source_title: str, target_title: str, source_text: str, target_text: str) -> str:
        known = self.answers.get((source_title, target_title)) or self.answers.get((target_title, source_title))
        return json.dumps(known or {"rel_type": "NONE", "confidence": 0.5, "reason": "no answer"})


class WithFeedback:
    """A provider that is asked again, with what was wrong, while its answer is no valid relation; at last the answer is NONE.

    Providers that take a further argument get the fault as such; others are just asked again.
    """

    def __init__(self, provider: Provider, retries: int = 3):
        self.provider, self.retries, self.name = provider, retries, provider.name

    def classify(self, source_title: str, target_title: str, source_text: str, target_text: str) -> str:
        fault = None
        for _ in range(self.retries + 1):
            if fault is not None and hasattr(self.provider, "classify_again"):
                answer = self.provider.classify_again(source_title, target_title, source_text, target_text, fault)
            else:
                answer = self.provider.classify(source_title, target_title, source_text, target_text)
            fault = answer_fault(answer)
            if fault is None:
                return answer
        return json.dumps({"rel_type": "NONE", "confidence": 0.0, "reason": fault})


def answer_fault(answer: str) -> str | None:
    """What keeps an answer from being a valid relation; the same rules as functions.relations.parsed_relation()."""
    begin, end = answer.find("{"), answer.rfind("}")
    try:
        x = json.loads(answer[begin : end + 1]) if 0 <= begin < end else None
    except ValueError as e:
        return f"not valid JSON: {e}"
    if not isinstance(x, dict):
        return "no JSON object"
    if set(x) - {"rel_type", "confidence", "reason", "direction"}:
        return "unknown keys"
    if str(x.get("rel_type")).strip().upper() not in RELATIONS:
        return f"rel_type must be one of {', '.join(RELATIONS)}"
    if isinstance(x.get("confidence"), bool) or not isinstance(x.get("confidence"), int | float) or not 0 <= x["confidence"] <= 1:
        return "confidence must be a number from 0 to 1"
    return None if x.get("direction", DIRECTIONS[0]) in DIRECTIONS else f"direction must be one of {', '.join(DIRECTIONS)}"


def classify(found: DataFrame, notes: DataFrame, provider: Provider, limit: int | None, settings: Settings | None = None, now: datetime | None = None) -> DataFrame:
    """Inferred relations (src, dst, rel_type, confidence, reason, model, created_at) of the best pairs of found, or of all without limit.

    notes(path, title, text). Answers that are no valid relation, NONE, and those of low confidence are dropped. The provider
    is called where the rows are; retries are its own.
    """
    s = settings or Settings()
    clip = F.substring("text", 1, s.excerpt_chars)
    best = found if limit is None else found.orderBy(F.desc("final_score"), "a", "b").limit(limit)
    x = notes.select(F.col("path").alias("a"), F.col("title").alias("ta"), clip.alias("xa"))
    y = notes.select(F.col("path").alias("b"), F.col("title").alias("tb"), clip.alias("xb"))
    rows = best.join(x, "a").join(y, "b").select("a", "b", "ta", "tb", "xa", "xb")

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"a": p["a"], "b": p["b"], "answer": [provider.classify(*r) for r in zip(p["ta"], p["tb"], p["xa"], p["xb"])]})

    said = rows.mapInPandas(ask, "a string, b string, answer string").withColumn("x", parsed_relation(F.col("answer")))
    kept = said.where((F.col("x.rel_type") != "NONE") & (F.col("x.confidence") >= s.persist_confidence))
    back = F.col("x.direction") == "target_to_source"
    at = (now or datetime.now(UTC)).isoformat()
    return kept.select(F.when(back, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(back, F.col("a")).otherwise(F.col("b")).alias("dst"), "x.rel_type", F.round("x.confidence", 4).alias("confidence"), "x.reason", F.lit(provider.name).alias("model"), F.lit(at).alias("created_at"))


def estimate(requests: DataFrame) -> DataFrame:
    """n_pairs, prompt_tokens, completion_tokens of requests(prompt, system)."""
    tokens = token_estimate("prompt") + token_estimate("system") + FRAME_TOKENS
    return requests.agg(F.count(F.lit(1)).alias("n_pairs"), F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("prompt_tokens"), (F.count(F.lit(1)) * ANSWER_TOKENS).alias("completion_tokens"))


def note_flags(found: DataFrame, inferred: DataFrame) -> DataFrame:
    """path, n_gaps and has_contradiction of each note with a gap or a relation (X02)."""
    a = found.select(F.explode(F.array("a", "b")).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n_gaps"))
    b = inferred.select(F.explode(F.array("src", "dst")).alias("path"), "rel_type").groupBy("path").agg(F.bool_or(F.col("rel_type") == "CONTRADICTS").alias("has_contradiction"))
    return a.join(b, "path", "full").select("path", F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), F.coalesce("has_contradiction", F.lit(False)).alias("has_contradiction"))


def best_evidence(found: DataFrame, chunks: DataFrame | None, dim: int = 64, near: DataFrame | None = None) -> DataFrame:
    """found with best_i, best_j and best_sim: the two chunks of each pair that are nearest (of equal ones the smallest ids).

    Of related notes these are among near, their chunk pairs of the floor (rel.related()); without it each chunk of a meets each of b.
    """
    sides = rel.all_sides(found.select("a", "b").distinct(), chunks, dim) if near is None else near
    best = sides.groupBy("a", "b").agg(F.min(F.struct((-F.round("sim", 5)).alias("down"), "i", "j")).alias("x"))
    return found.join(best.select("a", "b", F.col("x.i").alias("best_i"), F.col("x.j").alias("best_j"), (-F.col("x.down")).alias("best_sim")), ["a", "b"], "left")


def discover(chunks: DataFrame, graph: g.Graph, notes: DataFrame, inferred: DataFrame, provider: Provider, limit: int = 10, dismissed: DataFrame | None = None, settings: Settings | None = None, dim: int = 64) -> tuple[DataFrame, dict]:
    """(inferred with the new relations, what was done): gaps, the best of them asked about with feedback, valid answers kept once.

    The numbers: gaps, asked, kept (as relations), new (that were not there) and the estimated tokens.
    """
    s = settings or Settings()
    found = written(gaps(chunks, graph, inferred, dismissed, settings=s, dim=dim), "gaps")
    top = written(found.orderBy(F.desc("final_score"), "a", "b").limit(limit), "asked")
    said = written(classify(top, notes, WithFeedback(provider, s.max_retries), None, s), "relations")
    after = written(g.add_inferred(inferred, said.select(*inferred.columns)), "inferred")
    asked = top.join(notes.select(F.col("path").alias("a"), F.substring("text", 1, s.excerpt_chars).alias("prompt")), "a").withColumn("system", F.lit(""))
    tokens = estimate(asked).first()
    done = {"gaps": found.count(), "asked": top.count(), "kept": said.count(), "new": after.count() - inferred.count(), "prompt_tokens": tokens["prompt_tokens"], "completion_tokens": tokens["completion_tokens"]}
    return after, done
