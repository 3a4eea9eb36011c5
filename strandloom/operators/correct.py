"""Contig correction from pileups (CO1-CO5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.seq import CHUNK, chunks
from strandloom.operators.aln import cigar_ops
from strandloom.operators.chunked import base_at, joined, patched, piece_of, pieces, within
from strandloom.plans.tables import dealt_by_rows, saved

BASES = ("A", "C", "G", "T", "N")
#: Variants in the order in which equal votes are settled, after the contig's own base.
ORDER = {v: i for i, v in enumerate("ACGTND")}


def read_bases(aln: DataFrame) -> DataFrame:
    """One row for each base, deletion (D) and insertion (I, with its string) of aligned reads: contig, qname, pos, variant, inserted.
    Operations are cut into pieces first, so that the work grows with a read, not with its square."""
    return _bases_of(aln)


def _bases_of(aln: DataFrame, *carry: str) -> DataFrame:
    ops = cigar_ops(aln, ("seq", *carry))  # an alignment that repeats another counts by itself
    run = ops.where(F.col("op").isin("M", "=", "X")).select("contig", "qname", *carry, "r_start", F.posexplode(chunks(F.expr("substring(seq, q_start + 1, len)"), 1)).alias("n", "chunk"))
    each = run.select("contig", "qname", *carry, (F.col("r_start") + F.col("n") * CHUNK).alias("at"), F.posexplode(F.split("chunk", "")).alias("i", "base")).where("base <> ''")
    none = F.lit(None).cast("string").alias("inserted")
    rows = each.select("contig", "qname", *carry, (F.col("at") + F.col("i")).alias("pos"), F.upper("base").alias("variant"), none)
    gone = ops.where("op = 'D' and len > 0").select("contig", "qname", *carry, F.explode(F.expr("sequence(r_start, r_start + len - 1)")).alias("pos"), F.lit("D").alias("variant"), none)
    ins = ops.where("op = 'I'").select("contig", "qname", *carry, (F.col("r_start") - 1).alias("pos"), F.lit("I").alias("variant"), F.expr("substring(seq, q_start + 1, len)").alias("inserted"))
    return rows.unionByName(gone).unionByName(ins)


def pileup_votes(bases: DataFrame) -> DataFrame:
    """CO1: votes by contig, position and variant, and by inserted string."""
    return bases.groupBy("contig", "pos", "variant", "inserted").agg(F.count("*").alias("votes"))


def alignment_votes(aln: DataFrame) -> DataFrame:
    """CO1 from alignments (contig, pos, cigar, seq): what pileup_votes() says of their bases. Alignments that read alike are counted before
    a base becomes a row, and the votes are written once for all that reads them."""
    alike = aln.groupBy("contig", "pos", "cigar", "seq").agg(F.count("*").alias("alike")).withColumn("sample", F.lit("")).withColumn("qname", F.lit("")).withColumn("flag", F.lit(0))
    return saved(_bases_of(saved(alike, "alike-alignments"), "alike").groupBy("contig", "pos", "variant", "inserted").agg(F.sum("alike").alias("votes")), "votes")


def undefined_positions(contigs: DataFrame) -> DataFrame:
    """contig, pos of the letters of contigs other than ACGT; only chunks that hold some become rows."""
    cut = contigs.select("contig", F.posexplode(chunks(F.upper("seq"), 1)).alias("n", "chunk")).where(F.col("chunk").rlike("[^ACGT]"))
    each = cut.select("contig", F.col("n").cast("long").alias("n"), F.posexplode(F.split("chunk", "")).alias("i", "c")).where("c <> '' and c not in ('A', 'C', 'G', 'T')")
    return each.select("contig", (F.col("n") * CHUNK + F.col("i") + 1).alias("pos"))


def interesting_positions(votes: DataFrame, contigs: DataFrame, low: float = 0.1, high: float = 0.9, least: int = 20, anchor: int = 100, gap: int = 6) -> DataFrame:
    """CO2: contig, pos, kind. mixed: more than one base (or N) holds between `low` and `high` of more than `least` votes. undefined: the
    contig has no base there. anchor: the multiples of `anchor` (counted from 0) around such a position, `gap` of them on both sides of
    the one at or before it, as far as the contig goes; a contig without such a position has none.
    """
    base = votes.where(F.col("variant").isin(*BASES)).groupBy("contig", "pos", "variant").agg(F.sum("votes").alias("votes"))
    total = F.sum("votes").over(Window.partitionBy("contig", "pos"))
    held = base.withColumn("total", total).where(F.col("total") > least)
    ends = contigs.select("contig", F.length("seq").cast("long").alias("len"))
    mixed = held.where((F.col("votes") > low * F.col("total")) & (F.col("votes") < high * F.col("total"))).groupBy("contig", "pos").agg(F.count("*").alias("n")).where("n > 1")
    mixed = mixed.join(ends, "contig").where("pos between 1 and len").select("contig", "pos", F.lit("mixed").alias("kind"))
    none = undefined_positions(contigs).select("contig", "pos", F.lit("undefined").alias("kind"))
    own = mixed.unionByName(none).groupBy("contig", "pos").agg(F.min("kind").alias("kind"))
    blocks = own.select("contig", F.floor((F.col("pos") - 1) / anchor).alias("k")).distinct().select("contig", F.explode(F.sequence(F.col("k") - gap, F.col("k") + gap)).alias("k")).distinct()
    near = blocks.join(ends, "contig").where((F.col("k") >= 0) & (F.col("k") * anchor < F.col("len"))).select("contig", (F.col("k") * anchor + 1).alias("pos"), F.lit("anchor").alias("kind"))
    return own.unionByName(near.join(own, ["contig", "pos"], "left_anti"))


def consensus(votes: DataFrame, contigs: DataFrame, insertion: float = 1.5, changes_only: bool = False) -> DataFrame:
    """CO3: contig, pos, base, variant, inserted: the variant of most votes at each voted position; the contig's own base wins ties, then
    A, C, G, T, N, deletion; the most frequent insertion is added where `insertion` times its votes exceed those of the best base.

    Votes are summed before they meet the piece of the contig that they lie on. changes_only: positions at which something changes.
    """
    variant = F.col("variant")
    plain = votes.where(variant != "I").groupBy("contig", "pos", "variant").agg(F.sum("votes").alias("votes"))
    held = plain.groupBy("contig", "pos").agg(F.collect_list(F.struct("variant", "votes")).alias("v"))  # a handful of variants
    rank = F.create_map(*(F.lit(x) for pair in ORDER.items() for x in pair))
    own = base_at(held, contigs).withColumn("base", F.upper("base"))
    best = F.array_max(F.transform("v", lambda x: F.struct(x["votes"].alias("votes"), (x["variant"] == F.col("base")).alias("own"), (-F.coalesce(F.try_element_at(rank, x["variant"]), F.lit(6))).alias("nth"), x["variant"].alias("variant"))))
    added = votes.where(variant == "I").groupBy("contig", "pos").agg(F.max(F.struct("votes", "inserted")).alias("ins"), F.sum("votes").alias("ins_votes"))
    out = own.select("contig", "pos", "base", best.alias("b")).join(added, ["contig", "pos"], "left")
    wins = F.coalesce(F.col("ins_votes") * insertion > F.col("b.votes"), F.lit(False))
    out = out.select("contig", "pos", "base", F.col("b.variant").alias("variant"), F.when(wins, F.col("ins.inserted")).alias("inserted"))
    return out.where("(variant <> base and variant <> 'N') or inserted <> ''") if changes_only else out


def corrected_pieces(contigs: DataFrame, changes: DataFrame) -> DataFrame:
    """CO4: contig, piece, seq, n_changes: fixed pieces of the contigs, each patched by the few changes that lie on it."""
    at = F.col("pos") - 1
    new = F.when(F.col("variant").isNull() | (F.col("variant") == "N"), F.col("base")).when(F.col("variant") == "D", "").otherwise(F.col("variant"))
    real = changes.withColumn("new", F.concat(new, F.coalesce("inserted", F.lit("")))).where("new <> base")
    few = real.select("contig", piece_of(at).alias("piece"), F.struct(within(at).alias("at"), "new").alias("c")).groupBy("contig", "piece").agg(F.sort_array(F.collect_list("c")).alias("changes"))
    held = pieces(contigs).withColumn("bases", F.upper("bases")).join(few, ["contig", "piece"], "left")
    text = F.when(F.col("changes").isNull(), F.col("bases")).otherwise(patched(F.col("bases"), F.col("changes")))
    return held.select("contig", "piece", text.alias("seq"), F.coalesce(F.size("changes"), F.lit(0)).alias("n_changes"))


def corrected_contigs(contigs: DataFrame, changes: DataFrame) -> DataFrame:
    """CO4: contig, seq, n_changes after substituting, deleting and inserting what consensus() says; empty contigs give no row."""
    held = corrected_pieces(contigs, changes)
    counts = held.groupBy("contig").agg(F.sum(F.greatest("n_changes", F.lit(0))).alias("n_changes"))
    return joined(held, "seq", "contig").join(counts, "contig")


# fixed values: weight of a read by the number of its disagreements so far; none from the sixth on
ERROR_WEIGHT = (100, 10, 8, 5, 2, 1)


def read_weighted_consensus(bases: DataFrame, positions: DataFrame, contigs: DataFrame, strategy: str = "AllReads") -> DataFrame:
    """CO5: contig, pos, base, variant at interesting positions by reads that cover two or more of them. A read's weight falls with its
    disagreements in the sweep; the contig is swept in both directions, each from fresh weights, and the last verdict holds.

    strategy: AllReads, MappedSquared (weight times the square of agreements so far) or AllExceptJustStarted (as this strategy is
    computed, a read has a say at the first of its positions in the sweep only). Equal votes: the contig's own base, then A, C, G, T, N,
    deletion. The sweep is sequential along a contig and parallel over contigs, on interesting positions only.
    """
    places = _places(positions, contigs)
    rows = bases.where("variant <> 'I'").join(places, ["contig", "pos"])
    each = rows.groupBy("contig", "qname").agg(F.sort_array(F.collect_list(_mark("pos", F.col("variant"), "base"))).alias("marks"))
    held = saved(each.select("contig", F.monotonically_increasing_id().alias("part"), "marks"), "marked-reads")
    return _swept(held.select("contig", F.array("part").alias("parts"), F.lit(1).cast("long").alias("n")), held, places, strategy)


def alignment_weighted_consensus(aln: DataFrame, positions: DataFrame, contigs: DataFrame, strategy: str = "AllReads") -> DataFrame:
    """CO5 from alignments (qname, contig, pos, cigar, seq): what read_weighted_consensus() says of their bases.

    Alignments that read alike are counted before their CIGAR is read, those with the same marks (what they say at interesting positions)
    are one part, and reads of the same parts weigh alike all along the sweep. So a row of what is shuffled holds a read's name and a
    number for each alignment, and each distinct read reaches the sweep once, as these numbers.
    """
    key = ["contig", "pos", "cigar", "seq"]
    alike = saved(aln.groupBy(*key).agg(F.count("*").alias("alike")).withColumn("id", F.monotonically_increasing_id()), "alike-alignments")
    total = alike.agg(F.sum("alike")).first()[0] or 0
    places = _places(positions, contigs)
    marks = saved(places.groupBy("contig", piece_of(F.col("pos") - 1).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("pos", "base"))).alias("marks")), "marks")
    ops = cigar_ops(alike.withColumn("sample", F.lit("")).withColumn("qname", F.lit("")).withColumn("flag", F.lit(0)), ("seq", "id"))
    match = ops.where(F.col("op").isin("M", "=", "X")).select("contig", "id", "r_start", F.upper(F.expr("substring(seq, q_start + 1, len)")).alias("text"))
    gone = ops.where("op = 'D' and len > 0").select("contig", "id", "r_start", F.expr("repeat('D', len)").alias("text"))
    cut = match.unionByName(gone).where("text <> ''").select("contig", "id", "r_start", F.posexplode(chunks("text", 1)).alias("i", "text"))
    cut = cut.withColumn("a", F.col("r_start") + F.col("i") * CHUNK).withColumn("b", F.col("a") + F.length("text") - 1)
    held = cut.withColumn("piece", F.explode(F.sequence(piece_of(F.col("a") - 1), piece_of(F.col("b") - 1)))).join(marks, ["contig", "piece"])
    on = F.filter("marks", lambda m: m["pos"].between(F.col("a"), F.col("b")))
    said = F.transform(on, lambda m: _mark(m["pos"], F.substring(F.col("text"), (m["pos"] - F.col("a") + 1).cast("int"), F.lit(1)), m["base"]))
    of = held.groupBy("contig", "id").agg(F.sort_array(F.flatten(F.collect_list(said))).alias("marks")).where(F.size("marks") > 0)
    part = F.min("id").over(Window.partitionBy("contig", "marks"))
    parts = saved(of.withColumn("part", part).join(alike.select("id", "pos", "cigar", "seq"), "id"), "parts")
    # a missing sequence still has its deletions
    named = parts.select(*(F.col(c).alias(f"of_{c}") for c in key), "part")
    own = [*(aln[c] == named[f"of_{c}"] for c in key[:3]), aln["seq"].eqNullSafe(named["of_seq"])]
    said_by = dealt_by_rows(aln.join(named, own).select("contig", "qname", "part"), total, "contig", "qname")
    reads = said_by.groupBy("contig", "qname").agg(F.sort_array(F.collect_list("part")).alias("parts")).groupBy("contig", "parts").agg(F.count("*").alias("n"))
    return _swept(reads, parts.where("id = part").select("contig", "part", "marks"), places, strategy)


def _places(positions: DataFrame, contigs: DataFrame) -> DataFrame:
    """contig, pos, base of distinct positions on a contig."""
    return base_at(positions.select("contig", "pos").distinct(), contigs).withColumn("base", F.upper("base"))


def _mark(pos: Column | str, variant: Column, base: Column | str) -> Column:
    """What a read says at a position as one number: the position, the variant's code point (21 bits), whether it is the contig's own base."""
    pos, base = (F.col(c) if isinstance(c, str) else c for c in (pos, base))
    return pos.cast("long") * (1 << 22) + F.ascii(variant) * 2 + (variant == base).cast("int")


def _swept(reads: DataFrame, parts: DataFrame, places: DataFrame, strategy: str) -> DataFrame:
    """The verdicts by reads (contig, parts, n): n reads that say what the parts (contig, part, marks) say together.

    Of the two sweeps only the second is made: it starts from fresh weights and passes each position again, so no verdict of the first is left.
    """

    def sweep(reads: pa.Table, parts: pa.Table) -> pa.Table:
        if not reads.num_rows or not parts.num_rows:
            return pa.table({"contig": pa.array([], pa.string()), "pos": pa.array([], pa.int64()), "verdict": pa.array([], pa.string())})
        lists, marks, n = reads["parts"].combine_chunks(), parts["marks"].combine_chunks(), reads["n"].to_numpy()
        sizes, flat = marks.value_lengths().to_numpy(), marks.flatten().to_numpy()
        by_number = np.argsort(parts["part"].to_numpy())
        cls = by_number[np.searchsorted(parts["part"].to_numpy(), lists.flatten().to_numpy(), sorter=by_number)].astype(np.int32)
        owner = np.repeat(np.arange(len(n), dtype=np.int32), lists.value_lengths().to_numpy())
        enough = np.bincount(owner, weights=sizes[cls], minlength=len(n))[owner] >= 2
        cls, owner = cls[enough], owner[enough]
        # the reads of part c are owner[first[c]:first[c + 1]]
        owner, counts = owner[np.argsort(cls, kind="stable")], np.bincount(cls, minlength=len(sizes))
        first = np.concatenate([[0], np.cumsum(counts)])
        says = np.repeat(np.arange(len(sizes)), sizes)
        last = np.argsort(-(flat >> 22), kind="stable")
        says, flat = says[last], flat[last]
        ends = np.append(np.flatnonzero(np.diff(flat >> 22)) + 1, len(flat))
        errors, agreed = np.zeros(len(n), np.int32), np.zeros(len(n), np.int64)
        weights = np.array([*ERROR_WEIGHT, 0])
        places, verdicts, a = [], [], 0
        for b in ends:
            here, what, a = says[a:b], flat[a:b], b
            many = counts[here]
            if not many.any():
                continue
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            who, code = owner[np.repeat(first[here], many) + nth], np.repeat(what & ((1 << 22) - 1), many)
            had, won = errors[who], agreed[who]
            factor = {"AllReads": 1, "MappedSquared": won**2, "AllExceptJustStarted": (had == 0) & (won == 0)}[strategy]
            weight = weights[np.minimum(had, len(ERROR_WEIGHT))] * factor
            if int(weight.max()) * int(n.max()) * len(who) >= 1 << 62:
                weight = weight.astype(object)
            weight = weight * n[who]
            votes = {(chr(c >> 1), c): int(weight[code == c].sum()) for c in np.unique(code).tolist()}
            best = max(sorted(votes), key=lambda v: (votes[v], v[1] & 1, -ORDER.get(v[0], 6))) if any(votes.values()) else None
            same = code == best[1] if best else (code & 1) == 1
            np.add.at(agreed, who[same], 1)
            np.add.at(errors, who[~same], 1)
            places.append(int(what[0]) >> 22)
            verdicts.append(best and best[0])
        return pa.table({"contig": pa.array([parts["contig"][0].as_py()] * len(places), pa.string()), "pos": pa.array(places, pa.int64()), "verdict": pa.array(verdicts, pa.string())})

    made = reads.groupBy("contig").cogroup(parts.groupBy("contig")).applyInArrow(sweep, "contig string, pos long, verdict string")
    return made.join(places, ["contig", "pos"]).select("contig", "pos", "base", F.coalesce("verdict", "base").alias("variant"))
