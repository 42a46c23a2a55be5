"""Queries of the operators over the derived fixtures, and the DuckDB SQL they are held against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synframe.functions import sequence as sq
from synframe.operators import adjacency as ad
from synframe.operators import aligner as al
from synframe.operators import blockfinder as bf
from synframe.operators import filters as fl
from synframe.operators import inference as inf
from synframe.operators import intervals as iv
from synframe.operators import overlap as ov
from synframe.operators import phylogeny as ph
from synframe.operators import repeats as rp
from synframe.operators import scaffold as sc
from synframe.operators import simplify as si
from synframe.operators import verify as ve
from synframe.operators.components import connected_components
from synframe.plans import scaffolding
from synframe.plans.fixtures import ALN, B, CHAINED, CONTIGS, EDGES, FOUND, KMERS, PARTS, REP, SEQS, SEQUENCES, SKETCH, SPLICED, TREES, TRIM, clean, frame, sql
from synframe.runtime import Written
from synframe.sinks import reports as rep
from synframe.sources import text_formats as tf
from synframe.sources.blocks_view import DRAFT, GENOMES, TARGET, TREE, blocks, from_files, sequences
from synframe.sources.recipe import parse_newick
from synframe.sources.text_formats import with_complements

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def cleaned(s, d, loose=False):
    return fl.clean_blocks(blocks(s, d), TARGET, 5, loose)


def graph(s, d, loose=False):
    return ad.breakpoint_graph(cleaned(s, d, loose), TARGET, [DRAFT])


def contigs(s, d):
    return frame(s, d, B, SEQS, CONTIGS, select="select * from contigs")


def alignments(s, d):
    return frame(s, d, B, ALN, select="select * from aln")


def parts(s, d):
    return frame(s, d, PARTS, select="select * from fasta")


def docs(s, d):
    return s.read.parquet(f"{d}/documents.parquet")


# ---- coverage, multiplicity, filters ------------------------------------------------------------------------------


@query("block_coverage", sql(B, SEQS, "per as (select genome, chr, sum(bend - bstart) as c from blocks group by genome, chr)", select="select genome, cast(sum(c) as bigint) as covered, cast(sum(seq_len) as bigint) as total, round(sum(c) / sum(seq_len), 9) as coverage, round(sum(c) / sum(seq_len), 9) < 0.6 as low from per join seqs using (genome, chr) group by genome"))
def _(s, d):
    b = blocks(s, d)
    return fl.genome_coverage(b, sequences(b))


@query("sequence_coverage", sql(B, SEQS, select="select genome, chr, round(100 * sum(bend - bstart) / max(seq_len), 6) as percent from blocks join seqs using (genome, chr) group by genome, chr"))
def _(s, d):
    b = blocks(s, d)
    return fl.sequence_coverage(b, sequences(b))


@query("block_multiplicity", sql(B, select="select multiplicity, count(*) as n_blocks from (select block_id, count(*) as multiplicity from blocks group by block_id) group by multiplicity"))
def _(s, d):
    return fl.multiplicity_histogram(blocks(s, d))


@query("repeat_blocks", sql(B, REP, select="select block_id from rep"))
def _(s, d):
    return fl.repeat_blocks(blocks(s, d))


for _loose in (False, True):
    _tag = "loose" if _loose else "strict"

    def _filter(s, d, loose=_loose):
        return fl.filter_indels(blocks(s, d), TARGET, 5, loose)

    query(f"indel_filter_{_tag}", sql(B, clean(_loose), select="select * from kept"))(_filter)

    def _clean(s, d, loose=_loose):
        return cleaned(s, d, loose)

    query(f"clean_blocks_{_tag}", sql(B, clean(_loose), select="select * from clean"))(_clean)


@query("size_filter", sql(B, select="select * from blocks where block_id in (select block_id from blocks group by block_id having min(bend - bstart) >= 600)"))
def _(s, d):
    return fl.filter_by_size(blocks(s, d), 600)


@query("size_filter_any", sql(B, select="select * from blocks where block_id in (select block_id from blocks group by block_id having max(bend - bstart) >= 850)"))
def _(s, d):
    return fl.filter_by_size(blocks(s, d), 850, require_all=False)


@query("genome_tags", sql(B, select="select *, genome = 'g0' as is_target, genome = 'g4' as draft from blocks where genome in ('g0', 'g1', 'g4')"))
def _(s, d):
    g = s.createDataFrame([("g0", True, False), ("g1", False, False), ("g4", False, True), ("g9", False, False)], "genome string, is_target boolean, draft boolean")
    return fl.tag_genomes(blocks(s, d), g)


@query("sequence_uniqueness", sql(B, REP, select="select genome, chr, bool_and(r.block_id is not null) as all_repeats, bool_or(r.block_id is null) as has_unique from blocks b left join rep r on b.block_id = r.block_id group by genome, chr"))
def _(s, d):
    b = blocks(s, d)
    return fl.sequence_uniqueness(b, fl.repeat_blocks(b))


# ---- adjacencies and the graph ------------------------------------------------------------------------------------


@query("adjacency_edges", sql(B, clean(False), EDGES, select="select genome, chr, u, v, gap_start, gap_end from graph where not infinity"))
def _(s, d):
    return ad.adjacency_edges(cleaned(s, d)).drop("infinity")


@query("infinity_edges", sql(B, clean(False), EDGES, select="select genome, chr, u, v from graph where infinity"))
def _(s, d):
    return ad.infinity_edges(cleaned(s, d), TARGET, [DRAFT]).select("genome", "chr", "u", "v")


@query("contig_ends", sql(B, clean(False), EDGES, select="select chr, first_ as left_end, -last_ as right_end from ends where genome = 'g0'"))
def _(s, d):
    return ad.contig_ends(cleaned(s, d), TARGET)


@query("clamped_edges", sql(B, "o as (select genome, chr, block_id * sign as s, bstart, bend, lead(block_id * sign) over w as ns, lead(bstart) over w as nb, row_number() over w as ord from blocks window w as (partition by genome, chr order by bstart, block_id))", select="select genome, chr, ord, -s as u, coalesce(ns, 0) as v, least(bend, coalesce(nb, bend)) as left_pos, coalesce(nb, bend) as right_pos from o union all select genome, chr, 0, 0, s, bstart, bstart from o where ord = 1"))
def _(s, d):
    return ad.clamped_edges(blocks(s, d)).withColumn("ord", F.col("ord").cast("long"))


@query("edge_support", sql(B, clean(False), EDGES, select="select a, b, string_agg(distinct genome, ',' order by genome) as genomes, bool_or(infinity) as infinity from graph group by a, b"))
def _(s, d):
    return ad.edge_support(graph(s, d)).withColumn("genomes", F.array_join("genomes", ","))


@query("target_only_edges", sql(B, clean(False), EDGES, select="select a, b, bool_or(infinity) as infinity from graph group by a, b having bool_or(genome = 'g0') and (not bool_or(genome <> 'g0') or bool_or(infinity))"))
def _(s, d):
    return ad.suspicious_edges(graph(s, d), TARGET)


@query("common_genomes", sql(B, clean(False), EDGES, "n as (select distinct a as node, b as nbr, genome from graph union select b, a, genome from graph)", "deg as (select node, count(distinct nbr) as degree from n group by node)", "c as (select node, genome from n group by node, genome having count(distinct nbr) = (select degree from deg where deg.node = n.node))", select="select deg.node, degree, coalesce((select string_agg(genome, ',' order by genome) from c where c.node = deg.node), '') as genomes from deg"))
def _(s, d):
    return ad.common_genomes(graph(s, d))


RECURSIVE_CC = "e2 as (select a, b from {e} union select b, a from {e}), walk as (select a as node, a as seen from e2 union select w.node, e2.b from walk w join e2 on w.seen = e2.a)"


@query("bp_components", sql(B, clean(False), EDGES, RECURSIVE_CC.format(e="graph"), select="select node, min(seen) as component from walk group by node", recursive=True))
def _(s, d):
    return ad.graph_components(graph(s, d).select("a", "b"))


@query("bp_components_rounds", sql(B, clean(False), EDGES, RECURSIVE_CC.format(e="graph"), select="select node, min(seen) as component from walk group by node", recursive=True))
def _(s, d):
    # every round distributed: none is finished in one task
    return connected_components(graph(s, d), "a", "b", contract=False, few=0)


@query("discordant_nodes", sql(B, clean(False), EDGES, "n as (select a as node, b as nbr from graph where genome in ('g0', 'g1') and not infinity union all select b, a from graph where genome in ('g0', 'g1') and not infinity)", select="select node, count(distinct nbr) as neighbours from n group by node having count(distinct nbr) > 1"))
def _(s, d):
    return ad.discordant_nodes(graph(s, d), "g0", "g1")


@query("bifurcations", sql(B, clean(False), EDGES, "n as (select a as node, b as nbr from graph union all select b, a from graph)", select="select node, count(distinct nbr) as coloured, count(distinct nbr) > 1 or bool_or(nbr = -node) as bifurcation from n group by node"))
def _(s, d):
    return ad.bifurcations(graph(s, d))


@query("genome_distance", sql(B, clean(True), EDGES, "e as (select distinct genome, a, b from graph where not infinity)", "n as (select genome, count(*) as n from e group by genome)", select="select x.genome as g1, y.genome as g2, least(x.n, y.n) - (select count(*) from e p join e q on p.a = q.a and p.b = q.b where p.genome = x.genome and q.genome = y.genome) as distance from n x join n y on x.genome < y.genome"))
def _(s, d):
    return ad.genome_distance(cleaned(s, d, True))


@query("trimmed_graph", sql(B, clean(False), EDGES, TRIM, select="select a, b from trim_"))
def _(s, d):
    return ad.trimmed_graph(graph(s, d), TARGET)


@query("pair_adjacencies", sql(B, clean(False), EDGES, TRIM, "deg as (select n, count(*) as k from (select a as n from trim_ union all select b from trim_) group by n)", select="select a, b from trim_ join deg x on a = x.n join deg y on b = y.n where x.k = 1 and y.k = 1"))
def _(s, d):
    return ad.pair_adjacencies(ad.trimmed_graph(graph(s, d), TARGET))


TREE_EDGES = "tree(node, parent, len, leaf) as (values ('r', null, 0.0, false), ('x', 'r', 0.03, false), ('y', 'r', 0.05, false), ('z', 'y', 0.02, false), ('g0', 'x', 0.02, true), ('g1', 'x', 0.05, true), ('g2', 'y', 0.04, true), ('g3', 'z', 0.06, true), ('g4', 'z', 0.01, true))"
LEAF_RANK = "nb as (select node as p, parent as q, len from tree where parent is not null union all select parent, node, len from tree where parent is not null), dist as (select 'g0' as node, cast(null as varchar) as came, 0.0::double as d union all select nb.q, nb.p, dist.d + nb.len from dist join nb on nb.p = dist.node and (dist.came is null or nb.q <> dist.came))"


@query("leaf_distance", sql(B, TREE_EDGES, LEAF_RANK, select="select dist.node as genome, cast(row_number() over (order by round(d, 12), dist.node) - 1 as int) as rank, (select count(*) from blocks where genome = dist.node) as blocks from dist join tree on tree.node = dist.node where leaf", recursive=True))
def _(s, d):
    n = blocks(s, d).groupBy("genome").agg(F.count("*").alias("blocks"))
    return ph.rank_table(s, TREE, TARGET).join(n, "genome")


@query("edge_distance", sql(B, clean(False), EDGES, TREE_EDGES, LEAF_RANK, "r as (select dist.node as genome, row_number() over (order by round(d, 12), dist.node) as k from dist join tree on tree.node = dist.node where leaf)", select="select a, b, arg_min(gap_end - gap_start, k) as distance from graph join r using (genome) where not infinity group by a, b", recursive=True))
def _(s, d):
    return ad.edge_distances(graph(s, d), ph.rank_table(s, TREE, TARGET))


CTX = "ctx as (select genome, chr, block_id, sign, bstart, list(block_id * sign) over (w rows between 5 preceding and 1 preceding) as l, list(block_id * sign) over (w rows between 1 following and 5 following) as r from blocks window w as (partition by genome, chr order by bstart, block_id))"
CTX2 = "ctx2 as (select genome, chr, block_id, bstart, case when sign > 0 then l else list_transform(list_reverse(r), lambda x: -x) end as lf, case when sign > 0 then r else list_transform(list_reverse(l), lambda x: -x) end as rt from ctx where block_id in (select block_id from rep))"


@query("repeat_contexts", sql(B, REP, CTX, CTX2, select="select genome, chr, block_id, bstart, coalesce(array_to_string(lf, ','), '') as left_, coalesce(array_to_string(rt, ','), '') as right_ from ctx2"))
def _(s, d):
    b = blocks(s, d)
    c = ad.repeat_contexts(b, fl.repeat_blocks(b))
    return c.select("genome", "chr", "block_id", "bstart", F.array_join(F.col("left").cast("array<string>"), ",").alias("left_"), F.array_join(F.col("right").cast("array<string>"), ",").alias("right_"))


def aligned_sql() -> str:
    """Scores of context pairs (lists a, b from the far end on, flags ra, rb of repeats), the cells of the dynamic program written out one by one."""
    step = lambda i, j: f"(case when a[{i}] = b[{j}] then 1 else -1 end * case when ra[{i}] or rb[{j}] then {rp.REPEAT_MATCH} else {rp.MATCH} end)"
    cell = lambda i, j: "0" if not i or not j else f"d{i}{j}"
    cells = [f"greatest({cell(i - 1, j - 1)} + {step(i, j)}, {cell(i - 1, j)} + {rp.GAP}, {cell(i, j - 1)} + {rp.GAP}) as d{i}{j}" for i in range(1, 6) for j in range(1, 6)]
    grid = ", ".join(cell(i, j) for i in range(6) for j in range(6))
    return f"dp as (select *, {', '.join(cells)}, [{grid}][6 * len(a) + len(b) + 1] as side_score from sides2)"


SCORED = (
    "c3 as (select row_number() over () as id, genome, chr, block_id, bstart, coalesce(lf, []) as lf, coalesce(rt, []) as rt, (select list(block_id) from rep) as reps from ctx2)",
    "c4 as (select *, list_transform(lf, lambda x: abs(x) = block_id or list_contains(reps, abs(x))) as fl, list_transform(rt, lambda x: abs(x) = block_id or list_contains(reps, abs(x))) as fr from c3)",
    "pairs_ as (select x.id as x, y.id as y, x.lf, x.rt, x.fl, x.fr, y.lf as lf2, y.rt as rt2, y.fl as fl2, y.fr as fr2 from c4 x join c4 y using (block_id) where x.genome <> 'g0' and y.genome = 'g0' and len(y.lf) + len(y.rt) > 0)",
    "sides2 as (select x, y, lf as a, lf2 as b, fl as ra, fl2 as rb from pairs_ union all select x, y, list_reverse(rt), list_reverse(rt2), list_reverse(fr), list_reverse(fr2) from pairs_)",
)


@query("context_scores", sql(B, REP, CTX, CTX2, *SCORED, aligned_sql(), "total_ as (select x, y, sum(side_score) as score from dp group by x, y having sum(side_score) > 0)", select="select c.block_id, c.genome, c.chr, c.bstart, q.chr as qry, q.bstart as qry_start, score::bigint as score from total_ join c3 c on c.id = x join c3 q on q.id = y"))
def _(s, d):
    b = Written(s, "blocks").cut(blocks(s, d))
    r = fl.repeat_blocks(b)
    return rp.context_scores(ad.repeat_contexts(b, r), r, TARGET)


@query("context_dups", sql(B, REP, CTX, CTX2, "u as (select *, count(*) over (partition by genome, block_id, coalesce(lf, []), coalesce(rt, [])) as n from ctx2)", select="select genome, chr, block_id, bstart from u where n = 1"))
def _(s, d):
    b = blocks(s, d)
    return ad.unique_contexts(ad.repeat_contexts(b, fl.repeat_blocks(b))).select("genome", "chr", "block_id", "bstart")


# ---- intervals, order, statistics ---------------------------------------------------------------------------------


CUTS = "cuts as (select genome, chr, 5000 as cut from seqs where genome = 'g0' union all select genome, chr, cast(2000 + 1000 * (length(chr) + cast(substr(chr, 2) as bigint) % 5) as bigint) from seqs where genome = 'g0')"


@query("fragment_cut", sql(B, SEQS, CUTS, "f as (select b.*, seq_len, (select coalesce(max(cut), 0) from cuts c where c.genome = b.genome and c.chr = b.chr and cut <= bstart) as lo, (select min(cut) from cuts c where c.genome = b.genome and c.chr = b.chr and cut > bstart) as hi from blocks b join seqs using (genome, chr))", select="select genome, chr, lo as frag_start, coalesce(hi, seq_len) as frag_end, block_id, sign, bstart - lo as bstart, least(bend, coalesce(hi, seq_len)) - lo as bend from f"))
def _(s, d):
    b = blocks(s, d)
    c = frame(s, d, B, SEQS, CUTS, select="select genome, chr, cast(cut as bigint) as cut from cuts")
    return iv.cut_fragments(b, sequences(b), c)


FRAGS = "frags as (select chr, bstart as fs, max(bend) as fe from blocks where genome = 'g0' and bstart >= 0 group by chr, bstart)"


@query("interval_containment", sql(B, SEQS, CONTIGS, FRAGS, "j as (select c.*, fs, fe, case when sign > 0 then fs else -fs end as o from contigs c join frags f on c.chr = f.chr and s <= fs and fs < e)", select="select scf, idx, row_number() over w as n, chr, fs, fe, sign, case when lead(fs) over w is null then gap when sign > 0 then lead(fs) over w - fe else fs - lead(fe) over w end as gap, lead(fs) over w is not null as inner from j window w as (partition by scf, idx order by o)"))
def _(s, d):
    f = frame(s, d, B, FRAGS, select="select * from frags")
    return iv.containment(contigs(s, d), f).withColumn("n", F.col("n").cast("long"))


@query("collinear_islands", sql(B, ALN, "m as (select *, case when lag(qry) over w = qry and lag(strand) over w = strand then 0 else 1 end as nw from aln window w as (partition by ref order by ref_start, ref_end, qry, qry_start))", "i as (select *, sum(nw) over (partition by ref order by ref_start, ref_end, qry, qry_start rows unbounded preceding) as k from m)", select="select ref, min(qry) as qry, min(strand) as strand, min(ref_start) as ref_start, max(ref_end) as ref_end, min(qry_start) as qry_start, max(qry_end) as qry_end from i group by ref, k"))
def _(s, d):
    return iv.join_collinear(alignments(s, d))


@query("alignment_extents", sql(B, ALN, select="select qry as name, max(qry_end) as size, 'query' as kind from aln group by qry union all select ref, max(ref_end), 'reference' from aln group by ref"))
def _(s, d):
    return iv.alignment_extents(alignments(s, d))


@query("coverage_filter", sql(B, ALN, select="select qry, ref, strand, ref_start, ref_end, qry_start, qry_end from (select *, max(qry_end - qry_start) over (partition by qry) as m from aln) where qry_end - qry_start > 0.8 * m"))
def _(s, d):
    return fl.filter_by_coverage(alignments(s, d), 0.8)


@query("length_filter", sql(B, ALN, select="select * from aln where ref_end - ref_start > 600 and qry_end - qry_start > 600"))
def _(s, d):
    return fl.filter_by_length(alignments(s, d), 600)


@query("unique_contigs", sql(B, ALN, select="select * from aln where qry in (select qry from aln group by qry having count(*) = 1)"))
def _(s, d):
    return fl.unique_contigs(alignments(s, d))


@query("long_contigs", sql(B, ALN, select="select qry, max(ref_end) - min(ref_start) as span from aln group by qry having max(ref_end) - min(ref_start) >= 3000"))
def _(s, d):
    return fl.long_contigs(alignments(s, d), 3000)


SPANS = "spans as (select block_id * 10 + cast(substr(genome, 2) as bigint) * 1000000 + (bstart % 7) as id, concat(genome, chr) as seq, bstart as s, bend as e from blocks where bstart >= 0)"


@query("intersect_filter", sql(B, SPANS, "ids as (select *, row_number() over (order by seq, s, e, id) as k from spans)", "hit as (select x.k as k1, y.k as k2, x.e as e1, y.e as e2 from ids x join ids y on x.seq = y.seq and (y.s > x.s or y.s = x.s and (y.e > x.e or y.e = x.e and y.id > x.id)) and y.s < x.e)", select="select id, seq, s, e from ids where k not in (select k2 from hit) and k not in (select k1 from hit where e2 > e1)"))
def _(s, d):
    x = frame(s, d, B, SPANS, select="select * from spans")
    return fl.filter_intersecting(x, 2000)


@query("alignment_hits", sql(B, ALN, "q as (select distinct chr as qry from blocks where genome = 'g0')", select="select q.qry, count(aln.qry) as hits from q left join aln on q.qry = aln.qry group by q.qry having count(aln.qry) <> 1"))
def _(s, d):
    q = blocks(s, d).filter("genome = 'g0'").select(F.col("chr").alias("qry")).distinct()
    return fl.alignment_hits(q, alignments(s, d))


@query("dense_position", sql(B, ALN, "u as (select *, case when ref_start > lag(ref_start) over (partition by ref order by ref_start, qry, ref_end) then 1 when row_number() over (partition by ref order by ref_start, qry, ref_end) = 1 then (case when ref = (select min(ref) from aln) then 0 else 1 end) else 0 end as up from aln)", select="select ref, qry, ref_start, ref_end, cast(sum(up) over (order by ref, ref_start, qry, ref_end rows unbounded preceding) as bigint) as position from u"))
def _(s, d):
    return iv.dense_position(alignments(s, d))


@query("merge_consecutive", sql(B, SEQS, CONTIGS, "h as (select scf, idx * 2 + p as idx, chr, case when (p = 0) = (sign > 0) then s else (s + e) // 2 end as s, case when (p = 0) = (sign > 0) then (s + e) // 2 else e end as e, sign, case when p = 0 then 0 else gap end as gap from contigs, (values (0), (1)) t(p) where not (idx = 4 and p = 1))", "m as (select *, case when lag(chr) over w = chr and lag(sign) over w = sign and (case when sign > 0 then lag(e) over w = s else e = lag(s) over w end) then 0 else 1 end as nw from h window w as (partition by scf order by idx))", "i as (select *, sum(nw) over (partition by scf order by idx rows unbounded preceding) as k from m)", select="select scf, min(idx) as idx, min(chr) as chr, min(s) as s, max(e) as e, min(sign) as sign, arg_max(gap, idx) as gap from i group by scf, k"))
def _(s, d):
    h = "h as (select scf, idx * 2 + p as idx, chr, case when (p = 0) = (sign > 0) then s else (s + e) div 2 end as s, case when (p = 0) = (sign > 0) then (s + e) div 2 else e end as e, sign, case when p = 0 then 0 else gap end as gap from contigs, (values (0), (1)) t(p) where not (idx = 4 and p = 1))"
    return iv.merge_consecutive(frame(s, d, B, SEQS, CONTIGS, h, select="select * from h"))


@query("range_complement", sql(B, SEQS, "used as (select chr, bstart as s, bend as e from blocks where genome = 'g0' and bstart >= 0)", "q as (select chr, seq_len from seqs where genome = 'g0')", "a as (select chr, s, e from used union all select chr, 0, 0 from q union all select chr, seq_len, seq_len from q)", "n as (select *, lead(s) over (partition by chr order by s, e) as n from a)", select="select chr, e as s, n as e, case when e = 0 and n = seq_len then chr else format('{}[{}:{}]', chr, e, n) end as name from n join q using (chr) where e < n"))
def _(s, d):
    b = blocks(s, d).filter("genome = 'g0'")
    return iv.range_complement(b.filter("bstart >= 0").select("chr", F.col("bstart").alias("s"), F.col("bend").alias("e")), sequences(b))


POS = "pos as (select *, e - s as length, cast(coalesce(sum(e - s + gap) over (partition by scf order by idx rows between unbounded preceding and 1 preceding), 0) as bigint) as start, row_number() over (partition by scf order by idx) - 1 as i from contigs)"


@query("scaffold_positions", sql(B, SEQS, CONTIGS, POS, select="select scf, idx, chr, s, e, sign, gap, length, start from pos"))
def _(s, d):
    return iv.scaffold_positions(contigs(s, d))


@query("agp_rows", sql(B, SEQS, CONTIGS, POS, select="select scf, start + 1 as from_, start + length as to_, 2 * i + 1 as part, 'W' as kind, chr as component, length as size, case when sign > 0 then '+' else '-' end as strand from pos union all select scf, start + length + 1, start + length + gap, 2 * i + 2, 'N', 'scaffold', gap, '' from pos where gap > 0"))
def _(s, d):
    return iv.agp_rows(contigs(s, d)).withColumn("part", F.col("part").cast("long"))


@query("gap_update", sql(B, SEQS, CONTIGS, "g as (select c.*, (select min(bstart) from blocks b where b.genome = 'g0' and b.chr = c.chr) as left_gap, c.e - (select max(bend) from blocks b where b.genome = 'g0' and b.chr = c.chr) as right_gap from contigs c)", select="select scf, idx, case when lead(left_gap) over w is null then gap else gap - right_gap - lead(left_gap) over w end as gap from g window w as (partition by scf order by idx)"))
def _(s, d):
    b = blocks(s, d).filter("genome = 'g0'").groupBy("chr").agg(F.min("bstart").alias("left_gap"), F.max("bend").alias("m"))
    c = contigs(s, d).join(b, "chr").withColumn("right_gap", F.col("e") - F.col("m"))
    return iv.update_gaps(c).select("scf", "idx", "gap")


@query("gap_fix", sql(B, SEQS, CONTIGS, "q as (select *, concat(repeat('N', idx % 4), 'AC', repeat('G', idx), repeat('N', (idx * 2) % 5)) as seq, idx % 3 = 0 as assembly from contigs)", "l as (select *, lead(idx) over w is null as last, length(substr(seq, 2)) - length(rtrim(substr(seq, 2), 'N')) as r, lead(length(substr(reverse(seq), 2)) - length(rtrim(substr(reverse(seq), 2), 'N'))) over w as nl from q window w as (partition by scf order by idx))", "t as (select *, case when last or assembly then 0 else nl end as take from l)", select="select scf, idx, cast(coalesce(lag(take) over (partition by scf order by idx), 0) as bigint) as trim_left, cast(case when last then 0 when assembly then greatest(0, -gap) else r end as bigint) as trim_right, cast(case when last then gap when assembly then greatest(0, gap) else greatest(gap + r + nl, 11) end as bigint) as gap from t"))
def _(s, d):
    q = contigs(s, d).withColumn("seq", F.expr("concat(repeat('N', int(idx % 4)), 'AC', repeat('G', int(idx)), repeat('N', int((idx * 2) % 5)))")).withColumn("assembly", F.expr("idx % 3 = 0"))
    return iv.fix_gaps(q)


@query("n50", "with t as (select sum(n_chars) as total from documents), r as (select n_chars, sum(n_chars) over (order by n_chars desc, doc_id rows unbounded preceding) as run from documents) select cast(max(n_chars) as bigint) as n50, cast(max(total) as bigint) as total from r, t where run > total // 2")
def _(s, d):
    return iv.n50(docs(s, d).select(F.col("n_chars").alias("size")))


@query("assembly_stats", sql(B, SEQS, CONTIGS, select="select count(distinct scf) as scaffolds, count(*) as contigs, cast(sum(e - s) as bigint) as contig_length, cast(sum(case when gap > 0 then 1 else 0 end) as bigint) as gaps, cast(sum(greatest(gap, 0)) as bigint) as gap_length, round(100 * sum(greatest(gap, 0)) / sum(greatest(gap, 0) + e - s), 6) as gap_percent from contigs"))
def _(s, d):
    return iv.assembly_statistics(contigs(s, d))


VOTES = "mine as (select scf, block_id, blocks.sign * c.sign as sign from blocks join contigs c on blocks.chr = c.chr where genome = 'g0'), ref as (select block_id, chr as ref_chr, sign as ref_sign from blocks where genome = 'g1')"
VOTE_SQL = "v as (select scf, ref_chr, count(*) as votes, sum(case when sign = ref_sign then 1 else 0 end) as agree from mine join ref using (block_id) group by scf, ref_chr), t as (select scf, cast(sum(votes) as bigint) as total, cast(sum(agree) as bigint) as agree from v group by scf)"


@query("name_votes", sql(B, SEQS, CONTIGS, VOTES, VOTE_SQL, select="select scf, concat('chr_', (select string_agg(ref_chr, '_' order by votes desc, ref_chr) from v where v.scf = t.scf and v.votes * 10 > t.total)) as name, total, agree, agree < total // 2 as flip from t"))
def _(s, d):
    m = frame(s, d, B, SEQS, CONTIGS, VOTES, select="select * from mine")
    return iv.name_votes(m, blocks(s, d).filter("genome = 'g1'").select("block_id", F.col("chr").alias("ref_chr"), F.col("sign").alias("ref_sign")))


NAMES = "names as (select scf, concat('chr_', cast(length(scf) as string)) as name, count(*) as contigs from contigs group by scf)"


@query("name_suffix", sql(B, SEQS, CONTIGS, NAMES, "k as (select *, row_number() over (partition by name order by contigs desc, scf) as k, count(*) over (partition by name) as n from names)", select="select scf, concat(name, case when k = 1 then '' when n = 2 then '_unlocalized' else concat('_unlocalized.', cast(k - 1 as string)) end) as name, contigs from k"))
def _(s, d):
    return iv.suffix_names(frame(s, d, B, SEQS, CONTIGS, NAMES, select="select * from names"))


@query("flip_scaffolds", sql(B, SEQS, CONTIGS, "o as (select *, row_number() over w - 1 as i, count(*) over (partition by scf) as n, coalesce(lag(gap) over w, 0) as pg, cast(substr(scf, 2) as bigint) % 2 = 0 as f from contigs window w as (partition by scf order by idx))", select="select scf, case when f then n - 1 - i else i end as idx, chr, s, e, case when f then -sign else sign end as sign, case when f then pg else gap end as gap from o"))
def _(s, d):
    c = contigs(s, d)
    return iv.flip_scaffolds(c, c.filter("cast(substr(scf, 2) as bigint) % 2 = 0").select("scf").distinct())


@query("renumber_blocks", sql(B, "f as (select block_id, min(genome || '/' || chr || '/' || lpad(cast(bstart + 100000 as string), 9, '0')) as k, arg_min(sign, genome || '/' || chr || '/' || lpad(cast(bstart + 100000 as string), 9, '0')) as fs from blocks group by block_id)", "i as (select block_id, fs, row_number() over (order by k, block_id) as new_id from f)", select="select genome, chr, new_id as block_id, sign * fs as sign, bstart, bend from blocks join i using (block_id)"))
def _(s, d):
    return iv.renumber(blocks(s, d)).withColumn("sign", F.col("sign").cast("int"))


# ---- sequences and sinks ------------------------------------------------------------------------------------------


@query("reverse_complement", f"select doc_id, md5(reverse(translate(text, '{sq.IUPAC}', '{sq.IUPAC_COMPLEMENT}'))) as digest, length(text) as n from documents")
def _(s, d):
    return docs(s, d).select("doc_id", F.md5(sq.reverse_complement(F.col("text"))).alias("digest"), F.length("text").cast("long").alias("n"))


@query("fasta_wrap", "select doc_id, md5(rtrim(regexp_replace(replace(text, chr(10), ' '), '(.{60})', '\\1' || chr(10), 'g'), chr(10))) as digest from documents")
def _(s, d):
    return docs(s, d).select("doc_id", F.md5(sq.wrap(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("digest"))


@query("seq_with_complements", sql(PARTS, select="select '+' || name as name, seq from fasta union all select '-' || name, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) from fasta"))
def _(s, d):
    return with_complements(parts(s, d))


@query("longest_n_run", sql(PARTS, "r as (select name, seq, list_max(list_transform(regexp_extract_all(seq[5:24], 'N+'), lambda x: length(x))) as m from fasta)", select="select name, cast(case when m is null then 4 else 4 + instr(seq[5:24], repeat('N', m)) - 1 + m // 2 end as bigint) as cut from r"))
def _(s, d):
    return parts(s, d).select("name", sq.break_position(F.col("seq"), F.lit(4), F.lit(24)).alias("cut"))


OVERLAPS = "two as (select '+' || name as name, seq from fasta union all select '-' || name, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) from fasta), k as (select unnest(range(6, 13)) as k), sp as (select name, k, right(seq, k) as p, left(seq, k) as q from two, k), o as (select x.name as src, y.name as dst, cast(max(x.k) as int) as size from sp x join sp y on x.k = y.k and x.p = y.q and x.name <> y.name where not contains(x.p, 'N') group by 1, 2)"


@query("overlap_join", sql(PARTS, OVERLAPS, select="select * from o"))
def _(s, d):
    return ov.overlaps(with_complements(parts(s, d)), 6, 12)


@query("overlap_histogram", sql(PARTS, OVERLAPS, select="select size, count(*) as n from o group by size"))
def _(s, d):
    return ov.overlap_sizes(with_complements(parts(s, d)), 6, 12)


@query("overlap_mode", sql(PARTS, OVERLAPS, select="select * from o where size = (select size from o group by size order by count(*) desc, size limit 1)"))
def _(s, d):
    return ov.overlap_graph(parts(s, d), 6, 12)


@query("overlap_rate", sql(PARTS, OVERLAPS, select="select (select count(*) from o) as edges, (select count(*) from fasta) as contigs, (select count(*) from o) < 0.5 * (select count(*) from fasta) as low"))
def _(s, d):
    f = parts(s, d)
    return ov.overlap_rate(ov.overlap_sizes(with_complements(f), 6, 12), f)


SPARSE = "g as (select src, dst, size from o where size >= 7)"


@query("reachable", sql(PARTS, OVERLAPS, SPARSE, "w as (select src as start, src as node, 0 as depth from (select distinct src from g) union select w.start, g.dst, w.depth + 1 from w join g on w.node = g.src where w.depth < 4)", select="select start, node, cast(min(depth) as int) as depth from w group by start, node", recursive=True))
def _(s, d):
    e = ov.overlaps(with_complements(parts(s, d)), 6, 12).filter("size >= 7")
    return ov.reachable(e, e.select(F.col("src").alias("node")).distinct(), 4)


@query("direct_distances", sql(PARTS, OVERLAPS, "l as (select '+' || cast(p_partkey as string) as src, '-' || cast((p_partkey * 7 + 1) % 50 as string) as dst, p_partkey as idx from part)", select="select 's' as scf, idx, l.src, l.dst, cast(case when o.size is not null then -o.size else 100 end as bigint) as gap from l left join o on l.src = o.src and l.dst = o.dst"))
def _(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    l = p.select(F.lit("s").alias("scf"), F.col("p_partkey").alias("idx"), F.concat(F.lit("+"), F.col("p_partkey").cast("string")).alias("src"), F.concat(F.lit("-"), ((F.col("p_partkey") * 7 + 1) % 50).cast("string")).alias("dst"), F.lit(100).alias("gap"))
    return ov.reestimate_distances(l, ov.overlaps_of(l, with_complements(parts(s, d)), 6, 12))


SLICED = "fa as (select chr as name, repeat(translate(md5(chr), '0123456789abcdef', 'ACGTACGTACGNACGT'), cast(floor(seq_len / 32) as int) + 1) as seq from seqs where genome = 'g0')"


@query("scaffold_sequences", sql(B, SEQS, CONTIGS, SLICED, f"p as (select scf, idx, case when sign > 0 then substr(seq, s + 1, e - s) else reverse(translate(substr(seq, s + 1, e - s), '{sq.IUPAC}', '{sq.IUPAC_COMPLEMENT}')) end || case when gap > 0 then repeat('N', gap) else '' end as t from contigs c join fa on c.chr = fa.name)", select="select scf as name, md5(string_agg(t, '' order by idx)) as digest, cast(sum(length(t)) as bigint) as n from p group by scf"))
def _(s, d):
    fa = frame(s, d, B, SEQS, SLICED, select="select * from fa")
    return rep.scaffold_sequences(contigs(s, d), fa).select("name", F.md5("seq").alias("digest"), F.length("seq").cast("long").alias("n"))


@query("permutation_text", sql(B, select="select genome || '.' || chr as name, '>' || genome || '.' || chr || chr(10) || string_agg(case when sign > 0 then '+' else '-' end || block_id, ' ' order by bstart, block_id) || ' $' as line from blocks group by genome, blocks.chr").replace("chr(10)", "e'\\n'"))
def _(s, d):
    return rep.permutation_lines(blocks(s, d)).select(F.col("part").alias("name"), "line")


@query("fragments", sql(PARTS, select="select format('{}[{}:{}]', name, 3, 20) as name, substr(seq, 4, 17) as seq from fasta"))
def _(s, d):
    from synframe.sources.text_formats import fragments

    f = parts(s, d)
    return fragments(f, f.select("name", F.lit(3).alias("s"), F.lit(20).alias("e")))


# ---- simplification -----------------------------------------------------------------------------------------------


JOINS = """
ob as (select genome, chr, block_id * sign as s, bend, lead(block_id * sign) over w as v, lead(bstart) over w as nb, row_number() over w as r from blocks window w as (partition by genome, chr order by bstart, block_id)),
nn as (select -s as node, coalesce(v, 0) as nbr, coalesce(greatest(0, nb - bend), 0) as gap from ob union all select v, -s, greatest(0, nb - bend) from ob where v is not null union all select s, 0, 0 from ob where r = 1),
one as (select node, min(nbr) as nbr from nn group by node having min(nbr) = max(nbr) and min(nbr) <> 0 and max(gap) <= 1500 and abs(min(nbr)) <> abs(node)),
jj as (select x.node as a, x.nbr as b from one x join one y on x.nbr = y.node and y.nbr = x.node where x.node < x.nbr)
"""


@query("compressible_joins", sql(B, JOINS, select="select a, b from jj"))
def _(s, d):
    return si.compressible_joins(blocks(s, d), 1500)


@query("path_compress", sql(B, JOINS, "l as (select *, case when exists (select 1 from jj where a = least(-p, c) and b = greatest(-p, c)) then 0 else 1 end as nw from (select *, lag(block_id * sign) over w as p, block_id * sign as c from blocks window w as (partition by genome, chr order by bstart, block_id)))", "i as (select *, sum(nw) over (partition by genome, chr order by bstart, block_id rows unbounded preceding) as k from l)", select="select genome, chr, min(block_id) as block_id, arg_min(sign, block_id) as sign, min(bstart) as bstart, max(bend) as bend from i group by genome, chr, k"))
def _(s, d):
    return si.compress_paths(blocks(s, d), 1500)


BULGE = """
bb as (select block_id, s, bstart, -lag(s) over w as u, lead(s) over w as v, greatest(bstart - lag(bend) over w, lead(bstart) over w - bend) as g from (select *, block_id * sign as s from blocks) window w as (partition by genome, chr order by bstart, block_id)),
va as (select block_id, min(least(u, v)) as a, min(greatest(u, v)) as b from bb group by block_id
       having min(least(u, v)) = max(least(u, v)) and min(greatest(u, v)) = max(greatest(u, v)) and not bool_or(u is null or v is null) and max(g) <= 3000
          and abs(min(least(u, v))) <> abs(min(greatest(u, v))) and abs(min(least(u, v))) <> block_id and abs(min(greatest(u, v))) <> block_id),
nbr as (select -s as node, v as nbr from bb where v is not null union all select v, -s from bb where v is not null union all select s, 0 from bb where u is null union all select -s, 0 from bb where v is null),
dg as (select node, count(distinct nbr) as deg from nbr group by node),
ways as (select a, b, count(*) + (case when exists (select 1 from bb where v is not null and least(-s, v) = va.a and greatest(-s, v) = va.b) then 1 else 0 end) as w from va group by a, b)
"""


@query("bulge_removal", sql(B, BULGE, select="select * from blocks where block_id not in (select block_id from va join ways on va.a = ways.a and va.b = ways.b join dg x on x.node = va.a join dg y on y.node = va.b where w > 1 and x.deg = w and y.deg = w)"))
def _(s, d):
    return si.remove_bulges(blocks(s, d), 3000)


@query("simplify")
def _(s, d):
    return si.simplify(blocks(s, d), 2000)


@query("multi_scale")
def _(s, d):
    out = None
    for size, df in si.multi_scale(blocks(s, d), [(30, 500), (500, 2000)], [100, 600]).items():
        df = df.withColumn("block_size", F.lit(size))
        out = df if out is None else out.unionByName(df)
    return out


# ---- inference, chains, merging (component-local algorithms) --------------------------------------------------------


VOID = -(10**12)
CHANGE = "mu as (select 1 / len as mu from (select len, row_number() over (order by len) as k, count(*) over () as n from tree where parent is not null) where k = (n - 1) // 2 + 1), ch as (" + "select " + ", ".join(f"max(case when node = '{n}' then 1 + exp(-mu * greatest(len, 1e-7)) end) as {n}" for n in ("x", "y", "z", "g0", "g1", "g2", "g3", "g4")) + " from tree, mu where parent is not null)"


def costs(full: str) -> list[str]:
    """Parsimony cost ``c`` of each ``(node, x)`` with leaf states s0..s4 in the table ``full``: best states of the inner nodes x, z, y and r."""
    leaf = lambda i: f"case when s{i} = v.v or s{i} = {VOID} then 0 else ch.g{i} end"
    change = lambda n: f"case when q.v = p.v or q.v = {VOID} then 0 else ch.{n} end"
    return [
        f"v as (select distinct node, x, unnest([s0, s1, s2, s3, s4]) as v from {full})",
        f"lx as (select v.node, v.x, v.v, {leaf(0)} + {leaf(1)} as kx, {leaf(3)} + {leaf(4)} as kz, {leaf(2)} as k2 from v join {full} f on v.node = f.node and v.x = f.x, ch)",
        f"ly as (select p.node, p.x, p.v, p.kx, p.k2 + min(q.kz + {change('z')}) as ky from lx p join lx q on p.node = q.node and p.x = q.x, ch group by p.node, p.x, p.v, p.kx, p.k2)",
        f"lr as (select p.node, p.x, p.v, min(q.kx + {change('x')}) + min(q.ky + {change('y')}) as kr from ly p join ly q on p.node = q.node and p.x = q.x, ch group by p.node, p.x, p.v)",
        "cost as (select node, x, min(kr) as c from lr group by node, x)",
    ]


STATES = "nb2 as (select a as node, b as nbr, genome from graph union select b, a, genome from graph), own_ as (select node, " + ", ".join(f"max(nbr) filter (where genome = 'g{i}') as s{i}" for i in range(1, 5)) + " from nb2 group by node)"
FULL = "leafs as (select distinct nb2.node, nbr as x, nbr as s0, " + ", ".join(f"coalesce(s{i}, {VOID}) as s{i}" for i in range(1, 5)) + " from nb2 join own_ on nb2.node = own_.node)"


@query("weighted_graph", sql(B, clean(False), EDGES, TREE_EDGES, CHANGE, STATES, FULL, *costs("leafs"), "w as (select node, x, case when sum(c) over (partition by node) > 0 then c / sum(c) over (partition by node) else 0 end as w from cost)", select="select least(node, x) as a, greatest(node, x) as b, round(sum(w), 9) as weight from w group by 1, 2"))
def _(s, d):
    return inf.weighted_graph(graph(s, d), TREE, TARGET)


ADJACENT = """
m as (select a, b from matched union select a, b from graph where genome = 'g0'),
r(genome, k) as (values ('g0', 0), ('g1', 1), ('g4', 2), ('g2', 3), ('g3', 4)),
dd as (select a, b, arg_min(gap_end - gap_start, k) as d from graph join r using (genome) where not infinity group by a, b),
su as (select a, b, bool_or(infinity) as inf, string_agg(distinct genome || ':' || chr, ',' order by genome || ':' || chr) as sup from graph group by a, b),
one as (select m.a, m.b, case when inf then 0 else coalesce(d, 0) end as distance, case when inf then '' else sup end as supporting, inf as infinity from m join su using (a, b) left join dd using (a, b)),
adj as (select a as node, b as block, distance, supporting, infinity from one union all select b, a, distance, supporting, infinity from one)
"""
WALK = """
ce as (select chr, 'L' as side, first_ as node from ends where genome = 'g0' union all select chr, 'R', -last_ from ends where genome = 'g0'),
ln as (select x.chr, x.side, y.chr as chr2, y.side as side2, distance as gap, infinity as inf, supporting as sup from ce x join adj on x.node = adj.node join ce y on adj.block = y.node),
rw as (select chr as start, chr, 1 as sign, 0 as n, cast(0 as bigint) as gap, '' as sup from (select distinct chr from ln) q
       union all
       select rw.start, chr2, case when side2 = 'L' then 1 else -1 end, n + 1, ln.gap, ln.sup from rw join ln on ln.chr = rw.chr and ln.side = (case when sign > 0 then 'R' else 'L' end) and not inf where chr2 <> rw.start and n < 500),
lw as (select chr as start, chr, 1 as sign, 0 as n, cast(0 as bigint) as gap, '' as sup from (select distinct chr from ln) q
       union all
       select lw.start, chr2, case when side2 = 'R' then 1 else -1 end, n - 1, ln.gap, ln.sup from lw join ln on ln.chr = lw.chr and ln.side = (case when sign > 0 then 'L' else 'R' end) and not inf where chr2 <> lw.start and n > -500),
al as (select start, chr, sign, n, gap, sup from rw union all select start, chr, sign, n, gap, sup from lw where n < 0 and not exists (select 1 from rw where rw.start = lw.start and rw.chr = lw.chr)),
st as (select start from al group by start having min(chr) = start and (count(*) > 1 or exists (select 1 from ln where ln.chr = al.start and chr2 = al.start and side = 'R' and inf)))
"""
# a right link is stored on its own row; a left link on the contig that it leads to
CHAINS = "chains as (select 'scf_' || al.start as scf, row_number() over (partition by al.start order by n) - 1 as idx, chr, sign, cast(case when n < 0 then gap else coalesce(lead(gap) over (partition by al.start order by n), 0) end as bigint) as gap, case when n < 0 then sup else coalesce(lead(sup) over (partition by al.start order by n), '') end as supporting from al join st using (start))"
PAIRS = "deg as (select n, count(*) as k from (select a as n from trim_ union all select b from trim_) group by n), matched as (select a, b from trim_ join deg x on a = x.n join deg y on b = y.n where x.k = 1 and y.k = 1)"
#: every matching of every component, edge by edge in rising order; weights are compared in billionths
MATCHED = """
te2 as (select a, b from trim_ union select b, a from trim_),
tw as (select a as node, a as seen from te2 union select tw.node, te2.b from tw join te2 on tw.seen = te2.a),
te as (select trim_.a, trim_.b, c.comp, cast(round(weight * 1000000000) as bigint) as wt from trim_ join (select node, min(seen) as comp from tw group by node) c on c.node = trim_.a join wg on wg.a = trim_.a and wg.b = trim_.b),
mm as (select comp, [(a, b)] as es, [a, b] as used, wt, a, b from te
       union all
       select mm.comp, list_append(es, (te.a, te.b)), used || [te.a, te.b], mm.wt + te.wt, te.a, te.b from mm join te on te.comp = mm.comp and (te.a, te.b) > (mm.a, mm.b) and not list_contains(used, te.a) and not list_contains(used, te.b)),
matched as (select e[1] as a, e[2] as b from (select unnest(es) as e from mm qualify row_number() over (partition by comp order by len(es) desc, wt, es) = 1))
"""
WEIGHTED = (B, clean(False), EDGES, TRIM, TREE_EDGES, CHANGE, STATES, FULL, *costs("leafs"), "w as (select node, x, case when sum(c) over (partition by node) > 0 then c / sum(c) over (partition by node) else 0 end as w from cost)", "wg as (select least(node, x) as a, greatest(node, x) as b, round(sum(w), 9) as weight from w group by 1, 2)", MATCHED)


@query("min_weight_matching", sql(*WEIGHTED, select="select a, b from matched", recursive=True))
def _(s, d):
    return inf.min_weight_matching(graph(s, d), TREE, TARGET)


def _adjacencies(s, d, loose=False):
    """The clean blocks of a stage, written, and the adjacencies of their graph."""
    kept = Written(s, "graph")
    b = kept.cut(cleaned(s, d, loose))
    g = kept.cut(ad.breakpoint_graph(b, TARGET, [DRAFT]))
    target = g.filter("genome = 'g0'").select("a", "b").distinct()
    return b, inf.infer_adjacencies(g, inf.min_weight_matching(g, TREE, TARGET).unionByName(target).distinct(), ph.rank_table(s, TREE, TARGET))


@query("inferred_adjacencies", sql(*WEIGHTED, ADJACENT, select="select * from adj", recursive=True))
def _(s, d):
    return _adjacencies(s, d)[1].withColumn("supporting", F.array_join(F.transform("supporting", lambda x: F.concat_ws(":", x["genome"], x["chr"])), ","))


def stage_sql(loose: bool, tag: str) -> str:
    """Graph of one stage, and its suspicious edges with the outcome of the search for an alternating path, under names with a tag."""
    text = f"""{clean(loose)}, {EDGES},
    ee as (select a, b, genome from graph union select b, a, genome from graph),
    oo as (select a, b from ee group by a, b having bool_and(genome = 'g0')),
    moves as (select a, b, genome as g, 0 as odd from ee where genome <> 'g0' union all select a, b, g, 1 from oo, (values ('g1'), ('g2'), ('g3'), ('g4')) t(g)),
    sus as (select a as u, b as v from graph group by a, b having bool_or(genome = 'g0') and (not bool_or(genome <> 'g0') or bool_or(infinity))),
    wk as (select u, v, g, u as node, 0 as odd from sus, (values ('g1'), ('g2'), ('g3'), ('g4')) t(g)
           union
           select wk.u, wk.v, wk.g, m.b, 1 - wk.odd from wk join moves m on m.a = wk.node and m.g = wk.g and m.odd = wk.odd
           where m.b <> wk.u and not (m.b = wk.v and (wk.odd = 1 or wk.node = wk.u))),
    chim as (select u as a, v as b, (u, v) in (select (u, v) from wk where node = v and odd = 1) as good from sus)"""
    return re.sub(r"\b(kept|clean|edges0|ends|graph|ee|oo|moves|sus|wk|chim)\b", rf"\1{tag}", text)


@query("chimeric_edges", sql(B, stage_sql(False, "_0"), select="select a, b, good from chim_0", recursive=True))
def _(s, d):
    return inf.chimeric_edges(graph(s, d), TARGET)


BREAKS = ", ".join(f"br_{i} as (select distinct genome, chr, least(gap_start, gap_end) as s, greatest(gap_start, gap_end) as e, good from graph_{i} g join chim_{i} c on g.a = c.a and g.b = c.b where genome = 'g0' and not infinity)" for i in (0, 1))


@query("chimera_breaks", sql(B, stage_sql(False, "_0"), stage_sql(True, "_1"), BREAKS, "hit as (select x.genome, x.chr, x.s, x.e, min((y.s, y.e)) as h from br_0 x join br_1 y on x.genome = y.genome and x.chr = y.chr and greatest(x.s, y.s) <= least(x.e, y.e) where not x.good group by all)", select="select distinct 0 as stage, x.genome, x.chr, coalesce(greatest(x.s, h[1]), x.s) as cut from br_0 x left join hit using (genome, chr, s, e) where not good union select 1, genome, chr, s from br_1 where not good", recursive=True))
def _(s, d):
    return inf.break_cuts(inf.hierarchical_breaks([inf.contig_breaks(graph(s, d, x), TARGET) for x in (False, True)]))


def chains(s, d, loose=False):
    b, adj = _adjacencies(s, d, loose)
    return sc.build_chains(ad.contig_ends(b, TARGET), adj)


@query("scaffold_chains", sql(*WEIGHTED, ADJACENT, WALK, CHAINS, select="select * from chains", recursive=True))
def _(s, d):
    return chains(s, d)


def placed(s, d, loose=False):
    q = sequences(blocks(s, d)).filter("genome = 'g0'").select("chr", F.lit(0).cast("long").alias("s"), F.col("seq_len").alias("e"))
    return chains(s, d, loose).join(q, "chr")


LINK_LINES = (POS, "t as (select *, case when sign > 0 then '+' else '-' end || chr as name from pos)", "w_ as (select scf, greatest(8, max(length(name))) as w0, greatest(5, max(length(cast(start as varchar)))) as w1, greatest(6, max(length(cast(length as varchar)))) as w2, greatest(3, max(length(cast(gap as varchar)))) as w3 from t group by scf)")
LINK_TEXT = "select scf as part, cast(idx + 2 as int) as ord, rpad(name, w0::int, ' ') || '  ' || rpad(cast(start as varchar), w1::int, ' ') || '  ' || rpad(cast(length as varchar), w2::int, ' ') || '  ' || rpad(cast(gap as varchar), w3::int, ' ') || '  ' || {support} as line from t join w_ using (scf) union all select scf, 0, scf || e'\\n' || rpad('sequence', w0::int, ' ') || '  ' || rpad('start', w1::int, ' ') || '  ' || rpad('length', w2::int, ' ') || '  ' || rpad('gap', w3::int, ' ') || '  support' from w_"


@query("scaffold_links", sql(*WEIGHTED, SEQS, ADJACENT, WALK, CHAINS, "contigs as (select c.scf, c.idx, c.chr, 0 as s, seq_len as e, c.sign, c.gap, c.supporting from chains c join seqs q on q.genome = 'g0' and q.chr = c.chr)", *LINK_LINES, select=LINK_TEXT.format(support="supporting"), recursive=True))
def _(s, d):
    return rep.links_lines(placed(s, d))


def chains_sql(loose: bool = False) -> str:
    """The chains of a stage as one statement; it can stand inside another."""
    return sql(*[clean(True) if loose and x == clean(False) else x for x in WEIGHTED], ADJACENT, WALK, CHAINS, select="select scf, idx, chr, sign, gap from chains", recursive=True)


@query("merge_scaffolds", sql(f"big as ({chains_sql()})", f"small as ({chains_sql(True)})", SPLICED, select="select * from spliced"))
def _(s, d):
    return sc.merge_scaffolds(chains(s, d).drop("supporting"), chains(s, d, True).drop("supporting"))


@query("k_breaks")
def _(s, d):
    return sc.project_rearrangements(chains(s, d).drop("supporting"), chains(s, d, True).drop("supporting"))


@query("neighbor_joining")
def _(s, d):
    t = ph.infer_tree(ad.genome_distance(cleaned(s, d, True)), ["g0", "g1", "g2", "g3", "g4"])
    return s.createDataFrame([(t.newick(), round(ph.rate(t), 9))], "tree string, mu double")


def joining_sql() -> str:
    """Neighbour joining of the five genomes, join by join: distances ``dist`` (g1, g2, distance) to joins (node, parent, length)."""
    steps = ["d0 as (select g1 as i, g2 as j, distance::double as d from dist union all select g2, g1, distance from dist)", "node0 as (select distinct i as id, chr(39) || i as key from d0)"]
    for t in range(3):
        steps += [
            f"tot{t} as (select i, sum(d) as s, count(*) + 1 as n from d{t} group by i)",
            f"best{t} as (select a.i, a.j, a.d, p.key, a.d / 2 + (x.s - y.s) / (2 * (x.n - 2)) as half from d{t} a join tot{t} x on x.i = a.i join tot{t} y on y.i = a.j join node{t} p on p.id = a.i join node{t} r on r.id = a.j where p.key < r.key order by round((x.n - 2) * a.d - x.s - y.s, 9), p.key, r.key limit 1)",
            f"node{t + 1} as (select id, n.key from node{t} n, best{t} b where id <> i and id <> j union all select i || '+' || j, '(' || key from best{t})",
            f"new{t} as (select b.i || '+' || b.j as i, x.j as j, (x.d + y.d - b.d) / 2 as d from best{t} b join d{t} x on x.i = b.i join d{t} y on y.i = b.j and y.j = x.j)",
            f"d{t + 1} as (select d.i, d.j, d.d from d{t} d, best{t} b where d.i not in (b.i, b.j) and d.j not in (b.i, b.j) union all select * from new{t} union all select j, i, d from new{t})",
        ]
    joined = " union all ".join(f"select i as node, i || '+' || j as parent, greatest(1e-6, half) as length from best{t} union all select j, i || '+' || j, greatest(1e-6, d - half) from best{t}" for t in range(3))
    return ", ".join([*steps, f"joins_ as ({joined} union all select i, 'root', greatest(1e-6, d / 2) from d3)"])


DISTANCES = "dist as (select x.genome as g1, y.genome as g2, least(x.n, y.n) - (select count(*) from e p join e q on p.a = q.a and p.b = q.b where p.genome = x.genome and q.genome = y.genome) as distance from n x join n y on x.genome < y.genome)"


@query("neighbor_joins", sql(B, clean(True), EDGES, "e as (select distinct genome, a, b from graph where not infinity)", "n as (select genome, count(*) as n from e group by genome)", DISTANCES, joining_sql(), select="select node, parent, round(length, 9) as length from joins_"))
def _(s, d):
    def name(t):
        return t.name or "+".join(name(c) for c, _ in t.children)

    def rows(t, parent):
        return [x for c, n in t.children for x in [(name(c), parent, round(n, 9)), *rows(c, name(c))]]

    return s.createDataFrame(rows(ph.infer_tree(ad.genome_distance(cleaned(s, d, True)), list(GENOMES)), "root"), "node string, parent string, length double")


@query("repeat_profiles")
def _(s, d):
    b = blocks(s, d)
    r = fl.repeat_blocks(b)
    return rp.match_profiles(ad.repeat_contexts(b, r), r, TREE, TARGET, drafts=[DRAFT], repetitive=_pure(b, r))


def _pure(b, r):
    return fl.sequence_uniqueness(b, r).filter("genome = 'g0' and all_repeats")


@query("resolve_repeats")
def _(s, d):
    b = Written(s, "blocks").cut(blocks(s, d))
    r = fl.repeat_blocks(b)
    return rp.resolve_repeats(b, rp.match_profiles(ad.repeat_contexts(b, r), r, TREE, TARGET, drafts=[DRAFT], repetitive=_pure(b, r)), TARGET)


@query("refine_insert")
def _(s, d):
    f = parts(s, d)
    e = Written(s, "links").cut(ov.overlaps(with_complements(f), 6, 12))
    # a link for every pair of contigs two overlaps apart
    two = e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("far")).hint("merge"), "dst").filter("src <> far").select("src", F.col("far").alias("dst")).distinct()
    l = Written(s, "links").cut(two.select("src", "dst", F.concat_ws(">", "src", "dst").alias("scf"), F.lit(0).cast("long").alias("idx")))
    return ov.refine_paths(l, e, f.select("name", F.length("seq").alias("length")))


TRUE_ADJ = "hits as (select ref as chr, min(ref_start) as start, qry as contig, max(strand) as strand from aln group by ref, qry)"


@query("true_adjacencies", sql(B, ALN, clean(False), EDGES, TRUE_ADJ, "h as (select hits.chr, start, contig, case when strand > 0 then first_ else -last_ end as l, case when strand > 0 then -last_ else first_ end as r from hits join ends on ends.genome = 'g0' and ends.chr = contig)", select="select chr, r as u, coalesce(lead(l) over w, first_value(l) over w) as v, lead(l) over w is null as infinity from h window w as (partition by chr order by start, contig)"))
def _(s, d):
    h = frame(s, d, B, ALN, TRUE_ADJ, select="select * from hits")
    return ve.true_adjacencies(h, ad.contig_ends(cleaned(s, d), TARGET).withColumnRenamed("chr", "contig"))


@query("report_graph", sql(B, clean(False), EDGES, TRIM, select="select distinct a, b, 'base' as kind from graph union all select a, b, 'predicted' from trim_ union all select distinct a, b, 'true' from graph where genome = 'g1' and not infinity"))
def _(s, d):
    g = graph(s, d)
    return ve.report_graph(g, ad.trimmed_graph(g, TARGET), g.filter("genome = 'g1' and not infinity"))


@query("scaffolding_run")
def _(s, d):
    b = Written(s, "blocks").cut(blocks(s, d))
    q = sequences(b)
    out = scaffolding.run_scaffolding(s, {100: b, 600: fl.filter_by_size(b, 600)}, q, TARGET, ["g1", "g2", "g3", "g4"], [DRAFT], TREE)
    return out["contigs"]


@query("simulate_inversions", sql(B, SEQS, CONTIGS, select="select scf, idx, chr as contig, case when ('0x' || substr(md5(chr || ':1'), 1, 8))::bigint / 4294967296.0 < 0.2 then -sign else sign end as sign from contigs"))
def _(s, d):
    return ve.simulate_inversions(contigs(s, d).select("scf", "idx", F.col("chr").alias("contig"), "sign"), 0.2)


DENSE = "up_ as (select *, case when ref_start > lag(ref_start) over (partition by ref order by ref_start, qry, ref_end) then 1 when row_number() over (partition by ref order by ref_start, qry, ref_end) = 1 then (case when ref = (select min(ref) from aln) then 0 else 1 end) else 0 end as up from aln), dense as (select ref, qry, ref_start, sum(up) over (order by ref, ref_start, qry, ref_end rows unbounded preceding) as position from up_)"
HITS = "hits as (select d.qry as contig, d.ref as chr, position, m.strand, d.ref_start as start, 102000 as chr_len from dense d join (select qry, ref, ref_start, max(strand) as strand from aln group by qry, ref, ref_start) m on d.qry = m.qry and d.ref = m.ref and d.ref_start = m.ref_start)"
FOLD = """
o as (select scf, sign, chr as contig, row_number() over (partition by scf order by idx) as k from contigs where chr in (select contig from hits)),
pr as (select c.scf, c.k, count(*) = 1 as single, bool_or(b.position > a.position) as later,
         bool_or(a.chr = b.chr and (a.position < b.position or a.start > 0.8 * a.chr_len and b.start < 0.2 * a.chr_len)) as up,
         bool_or(a.chr = b.chr and (a.position >= b.position or a.start < 0.2 * a.chr_len and b.start > 0.8 * a.chr_len)) as down,
         bool_or(p.sign * a.strand = 1 and c.sign * b.strand = 1) as plus, bool_or(p.sign * a.strand = -1 and c.sign * b.strand = -1) as minus,
         min(abs(a.position - b.position)) > 1 as gap
       from o c join o p on c.scf = p.scf and p.k = c.k - 1 join hits a on a.contig = p.contig join hits b on b.contig = c.contig group by c.scf, c.k),
fold as (select scf, k, cast(null as boolean) as inc, 0 as bad, 0 as strand, 0 as gaps from o where k = 1
         union all
         select scf, k, case when serr then null else inc end, bad + err::int, strand + serr::int, gaps + gap::int from
           (select *, not err and not (case when coalesce(inc, false) then plus else minus end) as serr from
             (select f.scf, pr.k, f.bad, f.strand, f.gaps, pr.gap, pr.plus, pr.minus, f.inc is not null and not (case when f.inc then up else down end) as err,
                case when f.inc is not null and not (case when f.inc then up else down end) then null when f.inc is null and single then later else f.inc end as inc
              from fold f join pr on f.scf = pr.scf and pr.k = f.k + 1))),
checked as (select s.scf, coalesce(k, 0)::bigint as contigs, coalesce(bad, 0)::bigint as misordered, coalesce(strand, 0)::bigint as misstranded, coalesce(gaps, 0)::bigint as gaps
            from (select distinct scf from contigs) s left join (select * from fold qualify row_number() over (partition by scf order by k desc) = 1) f on s.scf = f.scf)
"""


def _order_check(s, d, order=None):
    a = alignments(s, d)
    pos = iv.dense_position(a.select("ref", "qry", "ref_start", "ref_end"))
    st = a.groupBy("qry", "ref", "ref_start").agg(F.max("strand").alias("strand"))
    h = pos.join(st, ["qry", "ref", "ref_start"]).select(F.col("qry").alias("contig"), F.col("ref").alias("chr"), "position", "strand", F.col("ref_start").alias("start"), F.lit(102000).alias("chr_len"))
    order = contigs(s, d) if order is None else order
    return ve.verify_order(order.select("scf", "idx", F.col("chr").alias("contig"), "sign"), h)


@query("order_check", sql(B, SEQS, CONTIGS, ALN, DENSE, HITS, FOLD, select="select * from checked", recursive=True))
def _(s, d):
    return _order_check(s, d)


@query("verify_order", sql(*WEIGHTED, SEQS, ADJACENT, WALK, CHAINS, "contigs as (select * from chains)", ALN, DENSE, HITS, FOLD, select="select * from checked", recursive=True))
def _(s, d):
    return _order_check(s, d, chains(s, d))


@query("order_totals", sql(B, SEQS, CONTIGS, ALN, DENSE, HITS, FOLD, select="select sum(misordered)::bigint as misordered, sum(misstranded)::bigint as misstranded, sum(gaps)::bigint as gaps, sum(contigs)::bigint as contigs, count(*) as scaffolds from checked", recursive=True))
def _(s, d):
    return ve.report_totals(_order_check(s, d))


# ---- trees --------------------------------------------------------------------------------------------------------


def tree_nodes(s, d):
    return ph.newick_nodes(s.sql(from_files(f"with {TREES['spark']} select tree, text from trees", d, ("supplier",))))


@query("newick_leaves", sql(TREES["duckdb"], select="select tree, name as leaf, cast(len as double) as length, cast(case when n = 1 then 0 when i = 1 then n - 1 else n - i + 1 end as int) as depth from leaf_ where n > 1"))
def _(s, d):
    return tree_nodes(s, d).filter("leaf").select("tree", F.col("name").alias("leaf"), "length", "depth")


@query("tree_rate", sql(TREES["duckdb"], "branch as (select tree, cast(len as double) as len from leaf_ where n > 1 union all select tree, 0.01 from leaf_ where i > 1 and i < n)", select="select tree, count(*) as branches, round(1 / quantile_disc(len, 0.5), 9) as mu from branch group by tree"))
def _(s, d):
    return tree_nodes(s, d).groupBy("tree").agg(F.count("*").alias("branches"), F.round(1 / F.expr("percentile_disc(0.5) within group (order by length)"), 9).alias("mu"))


@query("leaf_orders", sql(B, TREE_EDGES, "way as (select node, leaf, '' as k from tree where parent is null union all select t.node, t.leaf, k || case when t.leaf then '1' else '0' end || lpad(cast(cast(round((1 - t.len) * 1000000) as int) as varchar), 8, '0') from way join tree t on t.parent = way.node)", select="select node as leaf, (row_number() over (order by k, node) - 1)::int as place, (select count(*) from blocks where genome = node) as blocks from way where leaf", recursive=True))
def _(s, d):
    order = s.createDataFrame([(n, i) for i, n in enumerate(ph.leaves_depth_first(parse_newick(TREE)))], "leaf string, place int")
    return order.join(blocks(s, d).groupBy(F.col("genome").alias("leaf")).agg(F.count("*").alias("blocks")), "leaf")


#: presence (1) or absence (0, in the draft: no data) of every block in the genomes
PATTERNS = "pat as (select block_id as node, 0 as x, " + ", ".join(f"cast(max(case when genome = 'g{i}' then 1 else {VOID if i == 4 else 0} end) as bigint) as s{i}" for i in range(5)) + " from blocks group by block_id)"


@query("parsimony_patterns", sql(B, TREE_EDGES, CHANGE, PATTERNS, *costs("pat"), select="select node as block_id, round(c, 9) as cost from cost"))
def _(s, d):
    t = parse_newick(TREE)
    has = blocks(s, d).groupBy("block_id").agg(*[F.max((F.col("genome") == g).cast("long")).alias(g) for g in GENOMES])
    has = has.withColumn(DRAFT, F.when(F.col(DRAFT) == 1, F.col(DRAFT)))
    return ph.parsimony_column(has, t, {g: g for g in GENOMES}, ph.rate(t), "cost").select("block_id", F.round("cost", 9).alias("cost"))


# ---- readers: text is written from the tables and read back -----------------------------------------------------------


def _file(lines: DataFrame, tag: str, whole: bool = False) -> str:
    """Text files of rows (part, ord, line) in the shared folder, in order over their names, so that no task writes or sorts all rows. With
    ``whole`` the rows of a part stay in one file, for formats whose records are several rows."""
    path = f"{Written(lines.sparkSession, tag).root}/text"
    by = ["part"] if whole else ["part", "ord", "line"]
    lines.repartitionByRange(*by).sortWithinPartitions("part", "ord", "line").select("line").write.text(path)
    return path


def _line(df: DataFrame, part, line, order=0) -> DataFrame:
    return df.select(F.expr(part).cast("string").alias("part"), F.expr(str(order)).cast("int").alias("ord"), F.expr(line).alias("line"))


@query("read_fasta", sql(PARTS, select="select name, seq from fasta"))
def _(s, d):
    f = parts(s, d)
    old = f.filter("cast(name as bigint) % 2 = 0").select("name", F.concat(F.lit("TTTTTTTT"), F.reverse("seq")).alias("seq"))  # the later record wins
    return tf.read_fasta(s, _file(rep.fasta_lines(old, 9).unionByName(rep.fasta_lines(f, 12).withColumn("ord", F.lit(1))), "fasta"))


@query("read_fasta_unchecked", sql(PARTS, select="select name, upper(seq) || 'QZ' as seq from fasta"))
def _(s, d):
    f = parts(s, d).select("name", F.concat(F.lower("seq"), F.lit("qz")).alias("seq"))
    return tf.read_fasta(s, _file(rep.fasta_lines(f, 10), "fasta"), validate=False, upper=True)


@query("read_blocks_coords", sql(B, SEQS, select="select genome, chr, seq_len, block_id, sign, bstart, bend from blocks join seqs using (genome, chr)"))
def _(s, d):
    b = blocks(s, d)
    return tf.read_blocks_coords(s, _file(rep.coords_lines(b, sequences(b)), "coords"))


MAF = "rows_ as (select b.*, seq_len, bend - bstart as n from blocks b join seqs using (genome, chr)), long_ as (select * from rows_ where n >= 500 and not (block_id % 5 = 0 and genome = 'g2')), two as (select block_id, row_number() over (order by block_id) as id from long_ group by block_id having count(distinct genome || '.' || chr) > 1)"


@query("read_maf", sql(B, SEQS, MAF, select="select genome, chr, seq_len, id as block_id, sign, bstart, bend from long_ join two using (block_id)"))
def _(s, d):
    b = blocks(s, d)
    r = b.join(sequences(b), ["genome", "chr"]).withColumn("n", F.col("bend") - F.col("bstart"))
    text = "concat(repeat('A', cast(n as int)), case when block_id % 5 = 0 and genome = 'g2' then repeat('-', cast(n as int)) else '' end)"  # too many gaps
    line = f"concat_ws(' ', 's', concat(genome, '.', chr), case when sign > 0 then bstart else seq_len - bend end, n, case when sign > 0 then '+' else '-' end, seq_len, {text})"
    a = r.groupBy("block_id").agg(F.array_join(F.array_sort(F.collect_list(F.expr(line))), "\n").alias("t"))
    lines = _line(a, "lpad(block_id, 12, '0')", "concat('a score=1\n', t, case when block_id % 2 = 0 then '\n' else '' end)")  # every other one ends with a blank line
    return tf.read_maf(s, _file(lines.unionByName(s.createDataFrame([("", 0, "##maf version=1")], lines.schema)), "maf"), 500)


@query("read_gff", sql(B, select="select genome, chr, max(bend) over (partition by genome, chr) as seq_len, block_id, sign, bstart, bend from blocks"))
def _(s, d):
    line = "concat_ws('\t', concat(genome, '.', chr), 'x', 'block', bstart + 1, bend, '.', case when sign > 0 then '+' else '-' end, '.', concat('name=b;id=', block_id))"
    return tf.read_gff(s, _file(_line(blocks(s, d), "genome", line), "gff"))


@query("read_overlap_dot", sql(PARTS, OVERLAPS, select="select * from o"))
def _(s, d):
    return tf.read_overlap_dot(s, _file(rep.dot_lines(ov.overlaps(with_complements(parts(s, d)), 6, 12)), "dot"))


@query("read_nucmer", sql(B, ALN, select="select 'chr' || dense_rank() over (order by ref) as ref, qry, 1 as ref_strand, strand, ref_start, ref_end, qry_start, qry_end from aln"))
def _(s, d):
    line = "concat(' ', ref_start, ' ', ref_end, ' | ', if(strand > 0, qry_start, qry_end), ' ', if(strand > 0, qry_end, qry_start), ' | ', ref_end - ref_start, ' ', qry_end - qry_start, ' | 99.0 | ', ref, '\t', qry)"
    return tf.read_nucmer_coords(s, _file(_line(alignments(s, d), "ref", line), "nucmer"))


ALN_LEN = "al_ as (select aln.*, q.seq_len as qry_len, r.seq_len as ref_len from aln join seqs q on q.genome = 'g0' and q.chr = qry join seqs r on r.genome = 'g1' and r.chr = ref)"


@query("read_paf", sql(B, SEQS, ALN, ALN_LEN, select="select ref, qry, strand, ref_start, ref_end, qry_start, qry_end, qry_len, ref_len from al_"))
def _(s, d):
    line = "concat_ws('\t', qry, qry_len, qry_start, qry_end, if(strand > 0, '+', '-'), ref, ref_len, ref_start, ref_end, 1, 1, 60)"
    return tf.read_paf(s, _file(_line(frame(s, d, B, SEQS, ALN, ALN_LEN, select="select * from al_"), "ref", line), "paf"))


@query("read_pairwise_maf", sql(B, SEQS, ALN, ALN_LEN, select="select ref, qry, 1 as ref_strand, strand, ref_start, ref_end, qry_start, qry_end from al_"))
def _(s, d):
    ref = "concat_ws(' ', 's', ref, ref_start, ref_end - ref_start, '+', ref_len, 'ACGT')"
    qry = "concat_ws(' ', 's', qry, if(strand > 0, qry_start, qry_len - 1 - qry_end), qry_end - qry_start, if(strand > 0, '+', '-'), qry_len, 'ACGT')"
    return tf.read_pairwise_maf(s, _file(_line(frame(s, d, B, SEQS, ALN, ALN_LEN, select="select * from al_"), "ref", f"concat('a\n', {ref}, '\n', {qry}, '\n')"), "pairs"))


@query("read_order", sql(B, SEQS, CONTIGS, select="select scf, (row_number() over (partition by scf order by idx) - 1)::int as idx, chr as contig, sign from contigs"))
def _(s, d):
    c = contigs(s, d)
    body = _line(c, "scf", "concat(if(sign > 0, '+', '-'), chr, '[0:', e, ']  7  ', gap)", "idx + 1")
    return tf.read_order(s, _file(body.unionByName(_line(c.select("scf").distinct(), "scf", "concat('>', scf)")), "order", whole=True))


@query("read_permutations", sql(B, select="select genome || '.' || chr as name, (row_number() over (partition by genome, chr order by bstart, block_id) - 1)::int as ord, block_id * sign as signed_id from blocks"))
def _(s, d):
    return tf.read_permutations(s, _file(rep.permutation_lines(blocks(s, d)), "perm"))


@query("gene_order_text", sql(B, select="select genome as part, '>' || genome || e'\\n' || string_agg(t, e'\\n' order by chr) as line from (select genome, chr, string_agg(case when sign > 0 then '+' else '-' end || block_id, ' ' order by bstart, block_id) || ' $' as t from blocks group by genome, chr) group by genome"))
def _(s, d):
    return rep.gene_order_lines(blocks(s, d)).select("part", "line")


@query("genome_scale", sql(PARTS, select="select case when sum(length(seq)) < 50000 then 'small' else 'large' end as scale from fasta"))
def _(s, d):
    return s.createDataFrame([(tf.genome_scale(parts(s, d), 50_000),)], "scale string")


@query("overlap_joins", sql(PARTS, OVERLAPS, "used as (select cast(p_partkey as string) as chr, p_partkey + 1 as le, -(p_partkey + 1) as re from part where p_partkey % 3 = 0)", "lv as (select '+' || chr as node, re as e from used union all select '-' || chr, le from used)", "en as (select '+' || chr as node, le as e from used union all select '-' || chr, re from used)", "go as (select src, dst, dst in (select node from en) as stop from o)", "pw as (select lv.node as start, go.dst as node, stop, 1 as n from lv join go on lv.node = go.src union select pw.start, go.dst, go.stop, n + 1 from pw join go on go.src = pw.node where not pw.stop and n < 6)", select="select distinct least(lv.e, en.e) as a, greatest(lv.e, en.e) as b from pw join lv on pw.start = lv.node join en on en.node = pw.node where pw.stop and pw.start <> pw.node", recursive=True))
def _(s, d):
    used = s.read.parquet(f"{d}/part.parquet").filter("p_partkey % 3 = 0")
    ends = used.select(F.col("p_partkey").cast("string").alias("chr"), (F.col("p_partkey") + 1).alias("left_end"), (-F.col("p_partkey") - 1).alias("right_end"))
    return ov.overlap_joins(ends, ov.overlaps(with_complements(parts(s, d)), 6, 12), 6)


# ---- adjacencies and chains over the parts that SQL can express; report texts -----------------------------------------


@query("pair_inferred_adjacencies", sql(B, clean(False), EDGES, TRIM, PAIRS, ADJACENT, select="select * from adj"))
def _(s, d):
    g = Written(s, "graph").cut(graph(s, d))
    m = ad.pair_adjacencies(ad.trimmed_graph(g, TARGET)).unionByName(g.filter("genome = 'g0'").select("a", "b")).distinct()
    a = inf.infer_adjacencies(g, m, ph.rank_table(s, TREE, TARGET))
    return a.withColumn("supporting", F.array_join(F.transform("supporting", lambda x: F.concat_ws(":", x["genome"], x["chr"])), ","))


@query("pair_chains", sql(B, clean(False), EDGES, TRIM, PAIRS, ADJACENT, WALK, CHAINS, select="select scf, idx, chr, sign, gap from chains", recursive=True))
def _(s, d):
    g = Written(s, "graph").cut(graph(s, d))
    m = ad.pair_adjacencies(ad.trimmed_graph(g, TARGET)).unionByName(g.filter("genome = 'g0'").select("a", "b")).distinct()
    a = inf.infer_adjacencies(g, m, ph.rank_table(s, TREE, TARGET))
    return sc.build_chains(ad.contig_ends(cleaned(s, d), TARGET), a).drop("supporting")


@query("links_report", sql(B, SEQS, CONTIGS, *LINK_LINES, select=LINK_TEXT.format(support="''")))
def _(s, d):
    return rep.links_lines(contigs(s, d))


@query("agp_report", sql(B, SEQS, CONTIGS, POS, select="select scf as part, cast(2 * i + 1 as int) as ord, concat_ws(e'\\t', scf, start + 1, start + length, 2 * i + 1, 'W', chr, '1', length, case when sign > 0 then '+' else '-' end) as line from pos union all select scf, cast(2 * i + 2 as int), concat_ws(e'\\t', scf, start + length + 1, start + length + gap, 2 * i + 2, 'N', gap, 'scaffold', 'yes', 'align_genus') from pos where gap > 0"))
def _(s, d):
    return rep.agp_lines(contigs(s, d))


@query("coords_report", sql(B, SEQS, "q as (select *, row_number() over (order by genome, chr) as id from seqs)", "l as (select block_id, id, bstart, concat_ws(e'\\t', id, case when sign > 0 then '+' else '-' end, case when sign > 0 then bstart else bend end, case when sign > 0 then bend else bstart end, bend - bstart) as t from blocks join q using (genome, chr))", select="select '' as part, 0 as ord, e'Seq_id\\tSize\\tDescription' as line union all select '', cast(id as int), concat_ws(e'\\t', id, seq_len, genome || '.' || chr) from q union all select '~', cast(block_id as int), repeat('-', 80) || e'\\nBlock #' || block_id || e'\\nSeq_id\\tStrand\\tStart\\tEnd\\tLength\\n' || string_agg(t, e'\\n' order by id, bstart, t) from l group by block_id"))
def _(s, d):
    b = blocks(s, d)
    return rep.coords_lines(b, sequences(b))


@query("overlap_dot", sql(PARTS, OVERLAPS, select="select 'b' as part, 0 as ord, format('\"{}\" -> \"{}\" [label=\"{}\"];', src, dst, size) as line from o union all select 'a', 0, 'digraph {' union all select 'c', 0, '}'"))
def _(s, d):
    return rep.dot_lines(ov.overlaps(with_complements(parts(s, d)), 6, 12))


@query("scaffold_breakpoints", sql(B, clean(False), EDGES, select="select count(*) as breakpoints from (select a, b from graph where genome = 'g0' and not infinity) o where (a, b) in (select (a, b) from graph group by a, b having not bool_or(genome <> 'g0'))"))
def _(s, d):
    g = graph(s, d)
    return ad.scaffold_breakpoints(g.filter("genome = 'g0' and not infinity").select("u", "v"), g, TARGET)


@query("fasta_report", sql(PARTS, select="select name as part, 0 as ord, '>' || name || e'\\n' || rtrim(regexp_replace(seq, '(.{12})', '\\1' || chr(10), 'g'), chr(10)) as line from fasta"))
def _(s, d):
    return rep.fasta_lines(parts(s, d), 12)


@query("renamed_sequences", sql(B, "own as (select distinct genome, chr from blocks where genome in ('g0', 'g1'))", select="select b.chr, block_id, own.genome from blocks b join own on b.chr = own.chr where b.genome in ('g0', 'g1')"))
def _(s, d):
    from synframe.sources.text_formats import rename_sequences

    b = blocks(s, d).filter("genome in ('g0', 'g1')")
    return rename_sequences(b.select("chr", "block_id"), b.select("genome", "chr").distinct())


# ---- blocks and alignments from sequences alone -------------------------------------------------------------------


def genome_sequences(s, d, genomes=GENOMES):
    own = ", ".join(f"'{g}'" for g in genomes)
    return Written(s, "genomes").cut(frame(s, d, SEQUENCES["spark"], select=f"select genome, chr, seq from sequences where genome in ({own})"))


def found_blocks(s, d):
    return Written(s, "blocks").cut(bf.unitig_blocks(genome_sequences(s, d)))


def found_graph(s, d):
    return Written(s, "graph").cut(ad.breakpoint_graph(fl.clean_blocks(found_blocks(s, d), TARGET, 5, False), TARGET, [DRAFT]))


@query("branching_kmers", sql(SEQUENCES["duckdb"], KMERS, select="select node, side, low, high, open from sides where open or low <> high"))
def _(s, d):
    return bf.branching(genome_sequences(s, d), 15)


@query("unitig_blocks", sql(FOUND, select="select * from blocks"))
def _(s, d):
    return found_blocks(s, d)


@query("find_blocks")
def _(s, d):
    out = None
    for size, b in bf.find_blocks(genome_sequences(s, d), [30, 100]).items():
        b = b.select(F.lit(size).alias("size"), "genome", "chr", "block_id", "sign", "bstart", "bend")
        out = b if out is None else out.unionByName(b)
    return out


@query("sequence_graph", sql(FOUND, *WEIGHTED[1:-1], select="select * from wg", recursive=True))
def _(s, d):
    return inf.weighted_graph(found_graph(s, d), TREE, TARGET)


@query("sequence_scaffolds", sql(FOUND, *WEIGHTED[1:], ADJACENT, WALK, CHAINS, select="select * from chains", recursive=True))
def _(s, d):
    kept = Written(s, "found")
    clean_ = kept.cut(fl.clean_blocks(found_blocks(s, d), TARGET, 5, False))
    g = kept.cut(ad.breakpoint_graph(clean_, TARGET, [DRAFT]))
    known = g.filter(F.col("genome") == TARGET).select("a", "b").distinct()
    adj = inf.infer_adjacencies(g, inf.min_weight_matching(g, TREE, TARGET).unionByName(known).distinct(), ph.rank_table(s, TREE, TARGET))
    return sc.build_chains(ad.contig_ends(clean_, TARGET), adj)


def contig_alignments(s, d):
    g = genome_sequences(s, d, ("g0", "g1"))
    side = lambda genome: g.filter(F.col("genome") == genome).select(F.col("chr").alias("name"), "seq")
    return Written(s, "aligned").cut(al.align(side("g0"), side("g1")))


@query("minimisers", sql(SEQUENCES["duckdb"], SKETCH, select="select chr as name, kmer, p as pos, sign from mini where genome = 'g1'"))
def _(s, d):
    return al.minimisers(genome_sequences(s, d, ("g1",)).select(F.col("chr").alias("name"), "seq"))


@query("seed_segments", sql(SEQUENCES["duckdb"], SKETCH, select="select * from segment_"))
def _(s, d):
    g = genome_sequences(s, d, ("g0", "g1"))
    side = lambda genome: g.filter(F.col("genome") == genome).select(F.col("chr").alias("name"), "seq")
    return al.segments(side("g0"), side("g1"))


@query("contig_alignments", sql(SEQUENCES["duckdb"], SKETCH, CHAINED, select="select * from aligned", recursive=True))
def _(s, d):
    return contig_alignments(s, d)


@query("aligned_islands", sql(SEQUENCES["duckdb"], SKETCH, CHAINED, "aln as (select qry, ref, strand, ref_start, ref_end, qry_start, qry_end from aligned a where qry_end - qry_start > 0.45 * (select max(qry_end - qry_start) from aligned b where a.qry = b.qry))", "m as (select *, case when lag(qry) over w = qry and lag(strand) over w = strand then 0 else 1 end as b from aln window w as (partition by ref order by ref_start, ref_end, qry, qry_start))", "i as (select *, sum(b) over (partition by ref order by ref_start, ref_end, qry, qry_start rows unbounded preceding) as g from m)", select="select qry, ref, min(strand) as strand, min(ref_start) as ref_start, max(ref_end) as ref_end, min(qry_start) as qry_start, max(qry_end) as qry_end from i group by ref, g, qry", recursive=True))
def _(s, d):
    return iv.join_collinear(fl.filter_by_coverage(contig_alignments(s, d).drop("anchors"), 0.45))
