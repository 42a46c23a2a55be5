"""Inputs of the registered queries, derived from the driver's tables by SQL valid in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from synframe.sources.blocks_view import BLOCKS_SQL, from_files

B = f"blocks as ({BLOCKS_SQL})"
SEQS = "seqs as (select genome, chr, max(bend) + 1000 as seq_len from blocks group by genome, chr)"
REP = "rep as (select distinct block_id from (select genome, block_id from blocks group by genome, block_id having count(*) > 1) r)"


def clean(loose: bool) -> str:
    cond = "max(case when genome = 'g0' then 1 else 0 end) = 1 and max(case when genome <> 'g0' then 1 else 0 end) = 1" if loose else "count(*) >= 5"
    return (
        f"kept as (select * from blocks where block_id in (select block_id from blocks group by block_id having {cond})), "
        "clean as (select * from kept where block_id not in (select block_id from kept group by genome, block_id having count(*) > 1))"
    )


EDGES = """
edges0 as (select genome, chr, -block_id * sign as u, lead(block_id * sign) over w as v, bend as gap_start, lead(bstart) over w as gap_end
           from clean window w as (partition by genome, chr order by bstart, block_id)),
ends as (select genome, chr, min(case when rn = 1 then s end) as first_, max(case when rn = n then s end) as last_ from
           (select genome, chr, block_id * sign as s, row_number() over (partition by genome, chr order by bstart, block_id) as rn, count(*) over (partition by genome, chr) as n from clean) e
         group by genome, chr),
graph as (select genome, chr, least(u, v) as a, greatest(u, v) as b, u, v, gap_start, gap_end, false as infinity from edges0 where v is not null
          union all
          select genome, chr, least(-last_, first_), greatest(-last_, first_), -last_, first_, null, null, true from ends where genome in ('g1', 'g2', 'g3'))
"""
TRIM = """
tn as (select a as n from graph where genome = 'g0' union select b from graph where genome = 'g0'),
trim_ as (select distinct a, b from graph where genome <> 'g0' and a not in (select n from tn) and b not in (select n from tn))
"""
#: g0 sequences as contigs of scaffolds of ten.
CONTIGS = """
contigs as (select concat('s', cast(cast(floor(k / 10) as bigint) as string)) as scf, k % 10 as idx, chr, cast(0 as bigint) as s, cast(seq_len as bigint) as e,
              case when k % 3 = 0 then -1 else 1 end as sign, cast(case when k % 10 = 9 then 0 else (k * 37) % 60 - 8 end as bigint) as gap
            from (select chr, seq_len, cast(substr(chr, 2) as bigint) as k from seqs where genome = 'g0') q)
"""
#: blocks of g1 read as alignments of g0 contigs.
ALN = """
aln as (select t.chr as qry, r.chr as ref, r.sign * t.sign as strand, r.bstart as ref_start, r.bend as ref_end, t.bstart as qry_start, t.bend as qry_end
        from blocks r join blocks t on r.block_id = t.block_id where r.genome = 'g1' and t.genome = 'g0')
"""
#: short nucleotide sequences, one per part.
PARTS = "fasta as (select cast(p_partkey as string) as name, translate(md5(cast(p_partkey as string)), '0123456789abcdef', 'ACGTACGTACGNACGT') as seq from part)"


def frame(spark: SparkSession, sf_dir: str, *ctes: str, select: str) -> DataFrame:
    return spark.sql(from_files(f"with {', '.join(ctes)} {select}" if ctes else select, sf_dir))


def sql(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{', '.join(ctes)} {select}"

#: Sequences of the five genomes, written from ``documents``: a document's MD5 sums are a stretch of 128 nucleotides; a genome lacks one of
#: eleven stretches, has one letter exchanged in a third of them and one of thirteen turned round. g0 lies in contigs, the others in chromosomes.
_SEQUENCES = """
stretch as (select doc_id, translate(concat(md5(concat(text, 'a')), md5(concat(text, 'b')), md5(concat(text, 'c')), md5(concat(text, 'd'))), '0123456789abcdef', 'ACGTACGTACGTACGT') as s
            from documents where text is not null),
own as (select gno, doc_id, case when (doc_id + gno) % 3 = 0 then concat(substr(s, 1, 60), translate(substr(s, 61, 1), 'ACGT', 'CGTA'), substr(s, 62)) else s end as s
        from stretch cross join (select 0 as gno union all select 1 union all select 2 union all select 3 union all select 4) g where (doc_id * 3 + gno) % 11 <> 0),
turned as (select gno, doc_id, case when (doc_id * 7 + gno) % 13 = 0 then reverse(translate(s, 'ACGT', 'TGCA')) else s end as s,
                  case when gno = 0 then concat('c', cast(cast(floor(doc_id / 6) as bigint) as string)) else concat('r', cast(cast(floor(doc_id / 40) as bigint) as string)) end as chr from own),
sequences as (select concat('g', cast(gno as string)) as genome, chr, {joined} as seq from turned group by gno, chr)
"""
SEQUENCES = {
    "spark": _SEQUENCES.format(joined="array_join(transform(array_sort(collect_list(struct(doc_id, s))), x -> x.s), '')"),
    "duckdb": _SEQUENCES.format(joined="string_agg(s, '' order by doc_id, s)"),
}
#: The de Bruijn graph of the sequences' 15-mers and its contracted paths.
KMERS = """
cut as (select genome, chr, p, substr(seq, p + 1, 15) as f from sequences, unnest(range(0, length(seq) - 14)) u(p)),
strands_ as (select genome, chr, p, f, reverse(translate(f, 'ACGT', 'TGCA')) as r from cut),
walk as (select genome, chr, p, least(f, r) as node, case when f <= r then 1 else -1 end as sign from strands_),
steps as (select *, lead(node) over w as n2, lead(sign) over w as s2, lag(node) over w is null as left_end from walk window w as (partition by genome, chr order by p)),
half as (select node, case when sign > 0 then 'R' else 'L' end as side, n2 || case when s2 > 0 then 'L' else 'R' end as leads from steps
         union all select n2, case when s2 > 0 then 'L' else 'R' end, node || case when sign > 0 then 'R' else 'L' end from steps where n2 is not null
         union all select node, case when sign > 0 then 'L' else 'R' end, null from steps where left_end),
sides as (select node, side, min(leads) as low, max(leads) as high, bool_or(leads is null) as open from half group by node, side)
"""
PATHS = """
simple as (select node, side, low from sides where not open and low = high and left(low, 15) <> node),
joined as (select a.node, a.side from simple a join simple b on a.low = b.node || b.side and b.low = a.node || a.side),
often as (select node from walk group by node having count(*) > 1),
marked as (select w.genome, w.chr, w.p, w.node, w.sign, j.node is not null as on_ from walk w semi join often o on o.node = w.node
           left join joined j on j.node = w.node and j.side = case when w.sign > 0 then 'R' else 'L' end),
cuts_ as (select *, case when lag(p) over w = p - 1 and lag(on_) over w then 0 else 1 end as fresh from marked window w as (partition by genome, chr order by p)),
parts_ as (select *, sum(fresh) over (partition by genome, chr order by p) as no from cuts_),
found as (select genome, chr, ('0x' || translate(min(node), 'ACGT', '0123'))::bigint + 1 as block_id, cast(arg_min(sign, node) as int) as sign, min(p) as bstart, max(p) + 15 as bend from parts_ group by genome, chr, no)
"""
#: The blocks found in the sequences in place of those derived from ``lineitem``.
FOUND = f"{SEQUENCES['duckdb']}, {KMERS}, {PATHS}, blocks as (select * from found)"
#: Minimisers (5 of 15-mers) of contigs and of the references' sequences, anchors and segments.
SKETCH = """
km as (select genome, chr, p, substr(seq, p + 1, 15) as f, length(seq) - 14 as n from sequences, unnest(range(0, length(seq) - 14)) u(p) where genome in ('g0', 'g1')),
kc as (select genome, chr, p, n, least(f, reverse(translate(f, 'ACGT', 'TGCA'))) as kmer, case when f <= reverse(translate(f, 'ACGT', 'TGCA')) then 1 else -1 end as sign from km),
kv as (select *, (('0x' || translate(kmer, 'ACGT', '0123'))::bigint % 2147483647 * 48271 % 2147483647) * 2147483648 + p as v from kc),
kw as (select genome, chr, p, n, min(v) over (partition by genome, chr order by p rows between current row and 4 following) % 2147483648 as least_ from kv),
mini as (select distinct kc.genome, kc.chr, kc.p, kc.kmer, kc.sign from kc join (select genome, chr, least_ from kw where p <= greatest(0, n - 5)) l on l.genome = kc.genome and l.chr = kc.chr and l.least_ = kc.p),
rare_ as (select kmer from mini where genome = 'g1' group by kmer having count(*) <= 256),
anchor_ as (select q.chr as qry, r.chr as ref, q.sign * r.sign as strand, q.p as q, r.p as r, r.p - q.sign * r.sign * q.p as d
            from mini q join mini r on q.kmer = r.kmer join rare_ on rare_.kmer = r.kmer where q.genome = 'g0' and r.genome = 'g1'),
fresh_ as (select *, case when r - lag(r) over w <= 300 then 0 else 1 end as fresh from anchor_ window w as (partition by qry, ref, strand, d order by r)),
runs_ as (select *, sum(fresh) over (partition by qry, ref, strand, d order by r) as no from fresh_),
segment_ as (select qry, ref, strand, min(r) as ref_start, max(r) + 15 as ref_end, min(q) as qry_start, max(q) + 15 as qry_end, count(*) as anchors from runs_ group by qry, ref, strand, d, no)
"""
CHAINED = """
along as (select *, row_number() over (order by qry, ref, strand, ref_start, qry_start, ref_end, qry_end) as id, ref_start as rs, ref_end as re,
                 case when strand > 0 then qry_start else -qry_end end as qs, case when strand > 0 then qry_end else -qry_start end as qe from segment_),
able as (select a.id as i, b.id as j, greatest(b.rs - a.re, b.qs - a.qe) + abs((b.rs - a.re) - (b.qs - a.qe)) as cost, a.rs, a.qs, a.re, a.qe, b.rs as rs2, b.qs as qs2, b.re as re2, b.qe as qe2
         from along a join along b using (qry, ref, strand) where a.rs < b.rs and a.re < b.re and a.qs < b.qs and a.qe < b.qe
         and greatest(b.rs - a.re, b.qs - a.qe) <= 300 and least(b.rs - a.re, b.qs - a.qe) > -15),
chosen as (select * from able qualify row_number() over (partition by j order by cost, rs, qs, re, qe) = 1),
agreed as (select i, j from chosen qualify row_number() over (partition by i order by cost, rs2, qs2, re2, qe2) = 1),
heads as (select id as head, id from along where id not in (select j from agreed) union all select head, j from heads join agreed on agreed.i = heads.id),
aligned as (select qry, ref, cast(strand as int) as strand, min(ref_start) as ref_start, max(ref_end) as ref_end, min(qry_start) as qry_start, max(qry_end) as qry_end, sum(anchors)::bigint as anchors
            from along join heads using (id) group by head, qry, ref, strand)
"""
#: J11 over scaffold sets ``big`` and ``small`` (scf, idx, chr, sign, gap).
SPLICED = """
rep_ as (select distinct chr from (select 1 as w, chr from big union all select 2, chr from small) t group by w, chr having count(*) > 1),
b1 as (select big.*, rep_.chr is null as anchor from big left join rep_ using (chr)),
b2 as (select *, max(case when anchor then idx end) over (partition by scf order by idx) as at_, max(case when anchor then idx end) over (partition by scf) as end_ from b1),
s1 as (select small.*, o.chr is not null and rep_.chr is null as u, row_number() over (partition by scf order by idx) as pos from small left join rep_ using (chr) left join (select chr from b1 where anchor) o using (chr)),
s2 as (select *, sum(u::int) over w as seen, lag(gap) over w as before_, max(case when u then pos end) over w as lo from s1 window w as (partition by scf order by idx)),
p1 as (select scf, idx, chr, sign, lead(chr) over w as chr2, lead(sign) over w as sign2 from b1 where anchor window w as (partition by scf order by idx)),
p2 as (select p1.scf, p1.idx as at_, l.scf as from_, least(l.pos, r.pos) as lo, l.sign * p1.sign > 0 as same, case when l.sign * p1.sign > 0 then l.gap else l.before_ end as first_gap
       from p1 join s2 l on l.chr = p1.chr and l.u join s2 r on r.chr = chr2 and r.u
       where l.scf = r.scf and l.sign * p1.sign = r.sign * sign2 and (l.pos < r.pos) = (l.sign * p1.sign > 0) and abs(l.seen - r.seen) = 1 and abs(l.pos - r.pos) > 1),
o1 as (select scf, idx, 0 as k, chr, sign, case when idx = at_ then coalesce(first_gap, gap) else gap end as gap from b2 left join p2 using (scf, at_)
       where end_ is null or idx = at_ or (first_gap is null and at_ < end_)
       union all
       select p2.scf, at_, case when same then pos else 1000000 - pos end, chr, case when same then sign else -sign end, case when same then gap else before_ end from s2 join p2 on s2.scf = from_ and s2.lo = p2.lo where not u),
spliced as (select scf, row_number() over (partition by scf order by idx, k) - 1 as idx, chr, cast(sign as int) as sign, gap from o1)
"""

#: Trees as text, one for each nation: its suppliers joined one after the other.
_TREES = """
leaf_ as (select s_nationkey as tree, s_suppkey as k, concat('s', cast(s_suppkey as string)) as name, concat('0.0', cast(s_suppkey % 7 + 1 as string)) as len,
                 row_number() over (partition by s_nationkey order by s_suppkey) as i, count(*) over (partition by s_nationkey) as n from supplier),
piece as (select tree, n, k, case when i = 1 then concat(name, ':', len) else concat(',', name, ':', len, ')', case when i < n then ':0.01' else '' end) end as s from leaf_),
trees as (select tree, concat(repeat('(', cast(max(n) - 1 as int)), {joined}, ';') as text from piece group by tree)
"""
TREES = {
    "spark": _TREES.format(joined="array_join(transform(array_sort(collect_list(struct(k, s))), x -> x.s), '')"),
    "duckdb": _TREES.format(joined="string_agg(s, '' order by k)"),
}
