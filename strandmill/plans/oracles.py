"""DuckDB twins of the registered queries, over whole tables.

Written from the definition of each operator, not from its plan: windows where
Spark uses aggregates, unnested rows where it uses functions on arrays.
"""

from __future__ import annotations

from ..functions.conversion import REGISTRY
from ..operators.adapters import ADAPTERS, windows_of
from ..operators.align import MOCKS
from ..operators.umi import PATTERNS
from .views import HEX, NT

G = "(select 32 * count(*) from part)"
BLOCKS = f"blocks as (select p_partkey as block_id, translate(md5('g:' || p_partkey), '{HEX}', '{NT}') as seq from part)"
GENOME = BLOCKS + ", genome as (select 'chr_sim' as chrom, block_id * 32 + i as pos, substr(seq, i::int + 1, 1) as base from (select block_id, seq, unnest(range(32)) as i from blocks))"
TRUTH = GENOME + ", truth as (select chrom, pos, case when substr(md5('m:' || pos), 1, 2) < 'b3' then 1 else 0 end as methylated from genome where base = 'C')"
READS = "r as (select read_idx, library, mate, name, upper(trim(seq)) as seq, qual from reads where trim(seq) <> '')"
SAM = (
    READS[:-1] + " and length(trim(seq)) = length(qual))"
    + f""", sam as (select read_idx as line_no, split_part(ltrim(name, '@'), ' ', 1) as qname,
  case read_idx % 20 when 0 then 4 when 1 then 16 when 2 then 163 when 3 then 83 else 0 end as flag, 'chr_sim' as rname,
  (read_idx * 7919) % ({G} - 200) + 1 as pos, (read_idx * 37) % 61 as mapq,
  case read_idx % 7 when 1 then '5S45M' when 2 then '20M2I28M' when 3 then '25M3D25M' when 4 then '30S20M' when 5 then '10M5N40M' when 6 then '25=25X' else length(seq) || 'M' end as cigar,
  case when read_idx % 11 = 0 then 'chr_other' else '=' end as rnext, (read_idx * 53) % 1500 as tlen, seq, qual from r)"""
)
OPS = ", ops as (select line_no, unnest(range(1, len(c) + 1)) as op_no, unnest(c) as op, unnest(n)::int as len from (select line_no, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 2) as c, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 1) as n from sam))"


def bases(emit: str, ref: str, read: str) -> str:
    """CTE ``bases`` (all of sam's columns, aligned_idx, ref_pos, base)."""
    before = lambda kinds: f"coalesce(sum(case when contains('{kinds}', op) then len else 0 end) over (partition by line_no order by op_no rows between unbounded preceding and 1 preceding), 0)"
    return f"""{OPS}, placed as (select *, {before(ref)} as ref_off, {before(read)} as read_off from ops),
  each as (select line_no, op_no, ref_off + j as ref_off, read_off + j as read_off from (select *, unnest(range(len)) as j from placed where contains('{emit}', op))),
  bases as (select sam.*, row_number() over (partition by sam.line_no order by read_off) - 1 as aligned_idx, pos - 1 + ref_off as ref_pos, substr(seq, (read_off + 1)::int, 1) as base
    from each join sam using (line_no) where read_off < length(seq))"""


REF, READ, EMIT = "MDN=X", "MIS=X", "M=X"
STRANDED = bases(EMIT, REF, READ) + """, marked as (select *, case when flag & 16 <> 0 then '-' else '+' end as strand, substr(qual, aligned_idx::int + 1, 1) as q from bases where flag & 4 = 0 and aligned_idx < length(qual) and ref_pos >= 0),
  classed as (select *, base = case strand when '+' then 'C' else 'G' end as kept, base = case strand when '+' then 'T' else 'A' end as converted from marked)"""
GREADS = BLOCKS + f""", placed_reads as (select event_id as read_idx, (event_id * 7919 + user_id * 104729) % ({G} - 96) as start0 from events),
  raw as (select read_idx, start0, substr(a.seq || b.seq || c.seq, (start0 % 32)::int + 1, 50) as raw from placed_reads join blocks a on a.block_id = start0 // 32 join blocks b on b.block_id = start0 // 32 + 1 join blocks c on c.block_id = start0 // 32 + 2),
  gr as (select read_idx, start0, case when read_idx % 2 = 0 then translate(raw, 'C', 'T') else raw end as seq from raw)"""
THREE = "translate(regexp_replace(upper({0}), '[^ACGT]', '?', 'g'), 'ACGT?', '{1}0')"


def code(digits: str, k: int) -> str:
    return " + ".join(f"substr({digits}, {i + 1}, 1)::bigint * {3 ** (k - 1 - i)}" for i in range(k))


SEEDS = GREADS + f""", read_seed as (select read_idx, s::int as seed_start, {code("x", 10)} as code from (select read_idx, s, substr({THREE.format("seq", "0121")}, s::int + 1, 10) as x from (select *, unnest(range(0, 41, 5)) as s from gr))),
  ref_seed as (select 'chr_sim' as chrom, pos, {code("x", 10)} as code from (select block_id * 32 + i as pos, substr({THREE.format("long", "0121")}, i::int + 1, 10) as x from (select block_id, long, unnest(range(32)) as i from (select a.block_id, a.seq || coalesce(b.seq, '') as long from blocks a left join blocks b on b.block_id = a.block_id + 1))) where length(x) = 10)"""
HITS = SEEDS + ", hits as (select read_idx, seed_start, chrom, pos - seed_start as offs from read_seed join ref_seed using (code))"
CANDIDATES = HITS + f""", votes as (select read_idx, chrom, offs, count(*) as seeds, min(seed_start) as first_seed from hits group by all),
  cand as (select read_idx, chrom, least(greatest(offs, 0), {G} - 50) as start, seeds, cand_rank from (select *, row_number() over (partition by read_idx order by seeds desc, first_seed, offs) as cand_rank from votes) where cand_rank <= 5 and seeds >= 2)"""
REGIONS = CANDIDATES + """, regions as (select cand.*, gr.seq, substr(a.seq || coalesce(b.seq, '') || coalesce(c.seq, ''), (start % 32)::int + 1, 50) as region from cand join gr using (read_idx)
    join blocks a on a.block_id = start // 32 left join blocks b on b.block_id = start // 32 + 1 left join blocks c on c.block_id = start // 32 + 2),
  letters as (select *, substr(region, i::int, 1) as x, substr(seq, i::int, 1) as y from (select *, unnest(range(1, 51)) as i from regions))"""
CALLS = """cc as (select distinct aligner, coalesce(sample, 'none') as sample, lower(trim(chrom)) as chrom, pos, round_even(level, 4) as level, meth_count, unmeth_count, coverage from calls
  where chrom is not null and level is not null and not isnan(level) and level between 0 and 1 and coverage > 0)"""
JOINED = CALLS + ", j as (select cc.*, methylated, case when level > 0.5 then 1 else 0 end as called from cc join bed_sites using (chrom, pos))"


def metric_cte(keys: str) -> str:
    div = lambda a, b: f"(case when {b} = 0 then 0.0::double else ({a})::double / ({b})::double end)"
    return JOINED + f""", cm as (select {keys}, count(*) filter (called = 1 and methylated = 1) as tp, count(*) filter (called = 1 and methylated = 0) as fp, count(*) filter (called = 0 and methylated = 0) as tn, count(*) filter (called = 0 and methylated = 1) as fn from j group by all),
  pr as (select *, {div("tp", "tp + fp")} as p, {div("tp", "tp + fn")} as rc from cm),
  m as (select {keys}, round_even(p, 4) as precision, round_even(rc, 4) as recall, round_even({div("2 * p * rc", "(p + rc)")}, 4) as f1_score, round_even({div("tp + tn", "tp + fp + tn + fn")}, 4) as accuracy, tp + fp + tn + fn as sites_overlap, tp, fp, tn, fn from pr)"""


METRICS = metric_cte("aligner")
RESULTS = metric_cte("sample, aligner") + """, res as (select sample, substr(sample, 5, 3) as grp, case when coalesce(try_cast(nullif(regexp_extract(sample, '([0-9]+)$', 1), '') as int), 0) % 2 = 0 then 'ct' else 'ag' end as conversion, aligner, f1_score, precision, recall, accuracy, sites_overlap from m)"""
KEYED = "kr as (select read_idx, case when length(u) >= 4 then u end as umi from (select read_idx, regexp_replace(upper(trim(umi)), '[^ATCG]', 'N', 'g') as u from reads))"
LAYOUT = "lay as (select library, max(location) as location, coalesce(max(umi_length), 0) as umi_length from umi_stats group by library)"
QUALS = "r as (select read_idx, qual from reads where length(qual) > 0), q as (select read_idx, i - 1 as position, ascii(substr(qual, i::int, 1)) - 33 as v from (select read_idx, qual, unnest(range(1, length(qual) + 1)) as i from r))"


def cut_sql(seq: str, adapter: str) -> str:
    """Smallest offset where the adapter fits; null if nowhere."""
    a = f"'{adapter}'"
    o = f"least(length({seq}) - i, {len(adapter)})"
    same = f"len(list_filter(range(1, {o} + 1), lambda k: substr({seq}, (i + k)::int, 1) = substr({a}, k::int, 1)))"
    return f"list_min(list_filter(range(0, length({seq}) - 5), lambda i: {same} >= 6 and 1 - {same}::double / {o} <= 0.1::double))"


def trimmed(first: str, second: str) -> str:
    cuts = lambda adapter: f"least({', '.join(cut_sql('seq', x) for x in sorted({adapter, adapter.replace('C', 'T')}))}, 1000000000)"
    return READS + f", t as (select read_idx, seq, case when mate = 2 then {cuts(second)} else {cuts(first)} end as c from r), tr as (select read_idx, case when c < 1000000000 then substr(seq, 1, c::int) else seq end as seq, case when c < 1000000000 then c end as cut_at from t)"


def count_base(b: str) -> str:
    return f"sum(length(seq) - length(replace(seq, '{b}', '')))"


first_match = " ".join(f"when regexp_matches(name, '{p}') then regexp_extract(name, '{p}', {g})" for p, g in PATTERNS.values())
registry = ", ".join(f"('{c.tag}', '{c.key}', '{c.target}', '{c.converted}', '{c.complement_target}', '{c.complement_converted}')" for c in REGISTRY.values())
mocks = ", ".join(f"('{n}', {int(a * 65536)})" for n, a in MOCKS.items())
named = " ".join(f"when regexp_matches(tail, '{'|'.join(windows_of(s))}') then '{n}'" for n, s in ADAPTERS.items())
hex4 = lambda text: f"('0x' || substr(md5({text}), 1, 4))::int"
window = "order by f1_score desc, aligner"
FIELD = ' *(?:"(?:[^"]|"")*" *|[^"\\t]*)'
COLUMN = "trim(case when starts_with(trim({0}, ' '), '\"') then replace(substr(trim({0}, ' '), 2, length(trim({0}, ' ')) - 2), '\"\"', '\"') else {0} end, ' ')"
P5_NAMES = ("chrom", "start", "end", "level", "meth_count", "unmeth_count", "coverage")
whole = lambda c: f"(regexp_full_match(\"{c}\", '[0-9]+') and try_cast(\"{c}\" as bigint) is not null)"
LINES = f"""l as (select line_id, regexp_replace(raw_line, '\\r$', '') as s from raw_calls where regexp_matches(raw_line, '[^ \\r\\n]') and not regexp_matches(raw_line, '^(#|track |browser )')),
  f as (select line_id, s, regexp_full_match(s, '{FIELD}(?:\\t{FIELD})*') as quoted_well, regexp_full_match(s, '{FIELD}(?:\\t{FIELD}){{6}}') as seven, regexp_extract(s, '^{"".join((chr(92) + "t" if i else "") + "(" + FIELD + ")" for i in range(7))}$', {list(P5_NAMES)}) as x from l),
  v as (select line_id, quoted_well, seven, {", ".join(f'{COLUMN.format(f"x[{chr(39)}{c}{chr(39)}]")} as "{c}"' for c in P5_NAMES)} from f),
  told as (select v.*, s, case when not quoted_well then 'quoting' when not seven then 'column_count' when chrom = '' or not ({" and ".join(whole(c) for c in P5_NAMES if c not in ("chrom", "level"))})
    or not coalesce(regexp_full_match(level, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') and try_cast(level as double) between 0 and 1, false) or try_cast(meth_count as bigint) > try_cast(coverage as bigint) then 'invalid_value' end as reason from v join f using (line_id, quoted_well, seven))"""

# bytes of a line before the first that breaks it: what could be read, the line, seven columns, or the columns before the bad one
READABLE = f'^(?:{FIELD}\\t)*(?: *"(?:[^"]|"")*$| *"(?:[^"]|"")*" *|[^"\\t]*)'
bad_column = " ".join(f"when {c} then {i}" for i, c in enumerate(["chrom = ''", *(f"not {whole(c)}" for c in P5_NAMES[1:3]), "not coalesce(regexp_full_match(level, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') and try_cast(level as double) between 0 and 1, false)", *(f"not {whole(c)}" for c in P5_NAMES[4:])]))
OFFSETS = LINES + f""", bad as (select line_id, reason, s, case {bad_column} else 4 end as bad_no from told join f using (line_id, s) where reason is not null),
  spot as (select line_id, reason, case reason when 'quoting' then strlen(regexp_extract(s, '{READABLE}')) when 'column_count' then case when regexp_matches(s, '^(?:{FIELD}\\t){{7}}') then strlen(regexp_extract(s, '^(?:{FIELD}\\t){{7}}')) else strlen(s) end
    else strlen(regexp_extract(s, '^(?:{FIELD}\\t)' || '{{' || bad_no || '}}')) end as error_offset from bad)"""

MEAN = "round_even(sum((f1_score * 10000)::bigint)::double / (count(*) * 10000.0::double), 6)"

CLEAN = READS[:-1] + " and length(trim(seq)) = length(qual))"
NAMED = CLEAN + ", nr as (select read_idx, case when starts_with(name, '@') then name else '@' || name end as name, seq, qual from r where name is not null)"
CONTIGS = BLOCKS + ", ctg as (select 'ctg' || (block_id // 64) as chrom, string_agg(seq, '' order by block_id) as seq from blocks group by 1)"

ORACLES: dict[str, str] = {
    "fastq_scan": f"with {NAMED} select name, seq, qual from nr",
    "fastq_gzip_scan": f"with {NAMED} select ltrim(name, '@') as bare, seq, qual from nr",
    "fastq_indexed": f"with {NAMED} select row_number() over (order by read_idx) - 1 as read_idx, name from nr",
    "head_reads": f"with {READS} select read_idx, seq from r where read_idx < 1000",
    "fasta_scan": f"with {CONTIGS} select chrom, seq, length(seq) as length from ctg",
    "fasta_flat": f"with {CONTIGS} select chrom, b as block_id, substr(seq, (b * 1024 + 1)::int, 1024) as seq from (select *, unnest(range((length(seq) + 1023) // 1024)) as b from ctg)",
    "sam_scan": f"with {SAM} select qname, flag, rname, pos, mapq, cigar, rnext, (line_no * 7919) % ({G} - 200) + 151 as pnext, tlen, seq, qual from sam",
    "bed4_scan": 'select chrom, pos as "start", pos + 1 as "end", methylated from bed_sites',
    "results_file": f"with {RESULTS} select sample, aligner, f1_score, precision, recall, accuracy from res",
    "count_reads": "select library, count(*) as reads from reads group by library",
    "sam_mapped": f"with {SAM} select line_no, qname, flag, pos, cigar from sam where flag & 4 = 0",
    "sample_reads": f"with {READS} select read_idx, seq from r order by md5(read_idx || ':42'), read_idx limit 1000",
    "sample_pairs": f"with {READS} select read_idx, seq as seq1, reverse(translate(seq, 'ACGT', 'TGCA')) as seq2 from r order by md5(read_idx || ':42'), read_idx limit 500",
    "sample_pct": f"with {READS}, o as (select read_idx, library, row_number() over (order by md5(read_idx || ':42'), read_idx) as n, count(*) over () as total from r) select read_idx, library from o where n <= greatest(1, total * 5 // 100)",
    "truth_sites": f"with {TRUTH} select * from truth",
    "convert_bases": f"with {GENOME}, u as (select pos, base, base = 'C' and substr(md5('m:' || pos), 1, 2) < 'b3' as meth, {hex4("'c:' || pos")} / 65536.0::double as u from genome) select pos, base, case when base in ('C', 'G') and ((not meth and u < 0.99) or (meth and u >= 0.99)) then translate(base, 'CG', 'TA') else base end as converted from u",
    "revcomp": f"with {READS} select read_idx, reverse(translate(seq, 'ACGT', 'TGCA')) as rc from r",
    "adapter_detect": f"with {READS}, t as (select right(seq, 12) as tail, count(*) as reads from r where length(seq) >= 10 group by 1), n as (select sum(reads) as n from t), top as (select * from t order by reads desc, tail limit 20) select * from (select tail, reads, case {named} end as adapter from top, n where reads >= n * 0.001) where adapter is not null",
    "adapter_trim": f"with {trimmed(ADAPTERS['illumina_universal'], ADAPTERS['illumina_small_rna'])} select read_idx, seq, cut_at from tr",
    "trim_stats": f"with {trimmed(ADAPTERS['nextera'], ADAPTERS['nextera'])} select count(*) as total_reads, count(cut_at) as trimmed_reads, count(*) filter (seq = '') as empty_reads, sum(length(seq)) as bases_left from tr",
    "umi_detect": f"""with {READS}, h as (select library, {", ".join(f"avg(coalesce(regexp_matches(name, '{p}'), false)::int) as {n}" for n, (p, _) in PATTERNS.items())} from r group by library),
      l as (select library, pattern, max_by(length, (n, length)) as length from (select library, pattern, length, count(*) as n from ({" union all ".join(f"select library, '{n}' as pattern, length(regexp_extract(name, '{p}', {g}))::int as length from r where regexp_matches(name, '{p}')" for n, (p, g) in PATTERNS.items())}) group by all) group by library, pattern),
      e as (select library, side, count(*) as n from (select library, 'front' as side, left(seq, 8) as e from r where length(seq) >= 8 union all select library, 'back', right(seq, 8) from r where length(seq) >= 8) group by library, side, e),
      d as (select library, side, sum(1 - (1 - n / t) ** least(t, 200)) / least(any_value(t), 200) as differ from (select *, sum(n) over (partition by library, side)::double as t from e) group by library, side),
      p as (select h.library, (select differ from d where d.library = h.library and side = 'front') as front, (select differ from d where d.library = h.library and side = 'back') as back,
        case when standard > 0.5 then 'standard' when illumina_v3 > 0.5 then 'illumina_v3' when simple > 0.5 then 'simple' end as pattern from h)
      select library, case when pattern is not null then 'header' when front > 0.5 then 'inline_5prime' when back > 0.5 then 'inline_3prime' else 'none' end as location, pattern, length from p left join l using (library, pattern)""",
    "umi_extract": f"""with {READS}, {LAYOUT}, e as (select read_idx, case when location = 'header' then (case {first_match} end) when location = 'inline_5prime' and umi_length > 0 then left(seq, umi_length::int) when location = 'inline_3prime' and umi_length > 0 then right(seq, umi_length::int) end as u from r join lay using (library))
      select read_idx, case when length(trim(u)) >= 4 then regexp_replace(upper(trim(u)), '[^ATCG]', 'N', 'g') end as umi_found from e""",
    "umi_dedup": f"with {KEYED} select read_idx, umi from (select *, min(read_idx) over (partition by umi) as first from kr where umi is not null) where read_idx = first",
    "umi_stats": f"with {KEYED}, c as (select umi, count(*) as n from kr where umi is not null group by umi) select sum(n) as reads_with_umi, count(*) as unique_umis, count(*) filter (n > 1) as duplicate_groups, count(*) filter (n = 1) as singleton_groups, count(*) as reads_after_dedup, round_even(1 - count(*)::double / sum(n)::double, 4) as duplication_rate from c",
    "qc_totals": "with u as (select trim(seq) as s, qual, coalesce(trim(seq) <> '', false) as ok from reads) select count(*) as total_reads, coalesce(sum(length(s)) filter (ok), 0) as total_bases, count(*) filter (not ok) as without_seq, count(*) filter (ok and coalesce(length(s) <> length(qual), true)) as without_qual from u",
    "qc_base_pct": f"with {READS} select {', '.join(f'round_even(100.0::double * {count_base(b)} / sum(length(seq)), 4) as pct_{b.lower()}' for b in 'ACGTN')} from r",
    "qc_length_n50": f"with {READS}, o as (select length(seq) as l, sum(length(seq)) over (order by length(seq) desc) as upto, sum(length(seq)) over () as total from r) select round_even(avg(l), 4) as mean_length, min(l) as min_length, max(l) as max_length, max(l) filter (upto * 2 >= total) as n50 from o",
    "qc_gc_hist": f"with {READS} select (100 * (length(seq) - length(translate(seq, 'GC', ''))) // length(seq))::int as gc, count(*) as reads from r group by 1",
    "qc_read_quality": f"with {QUALS} select floor(s / n)::int as mean_quality, count(*) as reads from (select read_idx, sum(v)::double as s, count(*) as n from q group by 1) group by 1",
    "qc_per_base_quality": f"""with {QUALS}, o as (select position, v, row_number() over (partition by position order by v) as k, count(*) over (partition by position) as n from q)
      select position, round_even(avg(v), 4) as mean, {", ".join(f"min(v) filter (k >= ceil(n * {p}::double)) as {c}" for c, p in (("med", 0.5), ("q1", 0.25), ("q3", 0.75), ("lower", 0.1), ("upper", 0.9)))}, min(v) as min, max(v) as max from o group by position""",
    "qc_per_base_content": f"with {READS}, b as (select i - 1 as position, substr(seq, i::int, 1) as base from (select seq, unnest(range(1, length(seq) + 1)) as i from r)) select position, {', '.join(f'''count(*) filter (base = '{b}') as n_{b.lower()}''' for b in 'ACGTN')} from b group by position",
    "qc_length_hist": f"with {READS} select length(seq) as length, count(*) as reads from r group by 1",
    "qc_overrepresented": f'with {READS}, c as (select seq, count(*) as n from r group by 1) select seq as sequence, n as "count", round_even(100.0::double * n / (select count(*) from r), 4) as pct from c where n >= (select count(*) from r) * 0.001 order by n desc, seq limit 20',
    "qc_adapters": f"with {READS} " + " union all ".join(f"select '{n}' as adapter, count(*) filter (contains(seq, '{s[:12]}')) as reads, round_even(100.0::double * count(*) filter (contains(seq, '{s[:12]}')) / count(*), 4) as pct from r" for n, s in ADAPTERS.items()),
    "qc_grade": f"with {QUALS}, mq as (select floor(sum(v)::double / count(*)) as m from q group by read_idx), x as (select avg(m) as quality from mq), {READS.replace('r as', 'sr as')}, a as (select greatest({', '.join(f'round_even(100.0::double * count(*) filter (contains(seq, {chr(39)}{s[:12]}{chr(39)})) / count(*), 4)' for s in ADAPTERS.values())}) as adapter_pct from sr) select round_even(quality, 4) as quality, adapter_pct, case when quality >= 28 and adapter_pct <= 5 then 'PASS' when quality >= 20 then 'WARNING' else 'FAIL' end as grade from x, a",
    "conversion_types": f"with {READS}, c(tag, key, from_base, to_base, comp_from, comp_to) as (values {registry}), n as ({' union all '.join(f'''select '{b}' as from_base, {count_base(b)} as bases from r''' for b in 'ACGT')}) select * from c join n using (from_base)",
    "encode_3base": f"with {READS} select read_idx, {', '.join(f'{THREE.format(chr(115) + chr(101) + chr(113), REGISTRY[t].three_letter)} as {t}' for t in ('ct', 'ag', 'ac', 'gt', 'at', 'cg'))} from r",
    "kmer_code": f"with {READS} select read_idx, s::int as seed_start, {code('x', 16)} as code from (select read_idx, s, substr({THREE.format('seq', '0121')}, s::int + 1, 16) as x from (select read_idx, seq, unnest(range(length(seq) - 15)) as s from r where length(seq) >= 16))",
    "decode_2bit": f"with {READS} select read_idx, regexp_replace(seq, '[^ACGT]', 'A', 'g') as seq from r",
    "encode_2bit": f"""with {READS}, b as (select read_idx, (i // 32)::int as word_no, i % 32 as k, case substr(seq, i::int + 1, 1) when 'C' then 1 when 'G' then 2 when 'T' then 3 else 0 end as v from (select read_idx, seq, unnest(range(length(seq))) as i from r))
      select read_idx, word_no, (sum(case when k < 16 then v * (4 ** k)::bigint else 0 end)::hugeint + sum(case when k >= 16 then v * (4 ** (k - 16))::bigint else 0 end)::hugeint * 4294967296)::varchar as word from b group by 1, 2""",
    "cigar_parse": f"with {SAM}{OPS} select line_no, (op_no - 1)::int as op_no, op, len from ops",
    "cigar_expand": f"with {SAM}{bases(EMIT, REF, READ)} select line_no, aligned_idx, ref_pos, base from bases",
    "phred_decode": f"with {QUALS} select read_idx, sum(v) as sum_quality from q group by 1",
    "sam_flags": f"with {SAM} select flag & 4 <> 0 as unmapped, flag & 16 <> 0 as reverse, count(*) as reads from sam group by 1, 2",
    "seed_length_tier": f"with {READS} select case when length(seq) < 40 then 8 when length(seq) < 60 then 10 when length(seq) < 80 then 12 when length(seq) < 120 then 14 else 16 end as k, count(*) as reads from r group by 1",
    "ref_seed_index": f"with {SEEDS} select chrom, pos, code from ref_seed",
    "read_seeds": f"with {SEEDS} select read_idx, seed_start, code from read_seed",
    "seed_hits": f"with {HITS} select read_idx, count(*) as hits, count(distinct offs) as offsets from hits group by 1",
    "candidates_topk": f"with {CANDIDATES} select * from cand",
    "conv_mismatches": f"with {REGIONS} select read_idx, cand_rank, count(*) filter (replace(y, 'T', 'C') <> x) as mismatches from letters group by 1, 2",
    "best_hit": f"with {REGIONS}, s as (select read_idx, chrom, start, cand_rank, sum(case when x = y then 1 when x || y in ('CT', 'TC') then 0 else -1 end) as score from letters group by all) select * from s qualify row_number() over (partition by read_idx order by score desc, cand_rank) = 1",
    "mock_align": f"with {GREADS} select read_idx, ('0x' || substr(md5('p:' || read_idx), 1, 8))::bigint % ({G} - 50) + 1 as pos, 60 as mapq, '50M' as cigar from gr",
    "mock_call": f"with {GENOME}, k(aligner, sharp) as (values {mocks}), s as (select aligner, chrom, pos, {hex4('''concat_ws(':', 'm', aligner, pos)''')} < case when {hex4('''concat_ws(':', 'n', aligner, pos)''')} < sharp then {int(0.7 * 65536)} else {int(0.3 * 65536)} end as meth from genome, k where base = 'C') select aligner, chrom, pos, case when meth then 0.85 else 0.12 end::double as level, case when meth then 8 else 1 end as meth_count, case when meth then 2 else 9 end as unmeth_count, 10 as coverage from s",
    "call_ref_anchored": f"with {SAM}, {GENOME}{bases('M', 'MDN', 'MIS')}, s as (select rname as chrom, ref_pos as pos, count(*) filter (base = 'C') as meth_count, count(*) filter (base = 'T') as unmeth_count, count(*) as coverage from bases where flag & 4 = 0 group by 1, 2) select s.chrom, s.pos, round_even(meth_count::double / coverage, 4) as level, meth_count, unmeth_count, coverage from s join genome g on g.pos = s.pos and g.base = 'C'",
    "call_universal": f"with {SAM}{STRANDED}, s as (select rname as chrom, ref_pos as pos, count(*) filter (converted) as meth_count, count(*) filter (kept) as unmeth_count from classed where ascii(q) - 33 >= 20 and (kept or converted) group by 1, 2) select chrom, pos, round_even(meth_count::double / (meth_count + unmeth_count), 4) as level, meth_count, unmeth_count, meth_count + unmeth_count as coverage from s where meth_count + unmeth_count >= 5",
    "perbase": f"with {SAM}{STRANDED} select rname as chrom, ref_pos + 1 as pos, strand, coalesce(string_agg(q, '' order by line_no, aligned_idx) filter (converted), '') as converted_quals, count(*) filter (converted) as converted_count, coalesce(string_agg(q, '' order by line_no, aligned_idx) filter (kept), '') as unconverted_quals, count(*) filter (kept) as unconverted_count, round_even(count(*) filter (kept) / count(*)::double, 6) as unconverted_rate from classed where ascii(q) - 33 >= 0 and (kept or converted) group by 1, 2, 3",
    "streaming_calls": "select lower(trim(chrom)) as chrom, time_bucket(interval 1 day, called_ts) as day, count(*) as calls, sum(meth_count) as meth_count, sum(coverage) as coverage from calls where chrom is not null and called_ts is not null group by 1, 2",
    "filter_mapq": f"with {SAM} select line_no, mapq from sam where mapq >= 20",
    "filter_clip": f"with {SAM}{OPS} select line_no, cigar from sam where coalesce((select sum(len) from ops where ops.line_no = sam.line_no and op = 'S'), 0) / length(seq) <= 0.5",
    "filter_pair": f"with {SAM} select line_no, rnext, tlen from sam where (rnext in ('=', '*') or rnext = rname) and abs(tlen) <= 1000",
    "filter_unconverted": f"with {SAM} select line_no, length(seq) - length(replace(seq, 'C', '')) as unconverted, case when length(seq) - length(replace(seq, 'C', '')) <= 3 then 'kept' else 'rejected' end as outcome from sam",
    "filter_model": f"with {CANDIDATES} select read_idx * 10 + cand_rank as line_no from cand join gr using (read_idx) where start = start0",
    "consensus_level": f"with {CALLS} select aligner, case when coverage >= 5 and level >= 0.7 then 1.0 when coverage >= 5 and level <= 0.3 then 0.0 else level end as consensus_level, count(*) as sites from cc group by 1, 2",
    "context_posterior": f"""with {CALLS}, {GENOME}, s as (select pos % {G} as pos, sum(meth_count) as m, sum(coverage) as c from cc group by 1), f as (select s.*, coalesce(a.base, '') || b.base || coalesce(c2.base, '') as motif from s join genome b on b.pos = s.pos left join genome a on a.pos = s.pos - 1 left join genome c2 on c2.pos = s.pos + 1),
      p as (select motif, sum(m)::double / sum(c)::double as prior from f group by 1) select pos, motif, round_even(prior, 6) as prior, round_even((prior * 2 + m::double) / (2 + c::double), 6) as posterior from f join p using (motif)""",
    "motif_enrichment": f"""with {TRUTH}, f as (select coalesce(a.base, '') || 'C' || coalesce(c.base, '') as motif, methylated from truth t left join genome a on a.pos = t.pos - 1 left join genome c on c.pos = t.pos + 1),
      p as (select motif, count(*) filter (methylated = 1) as methylated, count(*) filter (methylated = 0) as unmethylated from f group by 1), n as (select sum(methylated)::double as tm, sum(unmethylated)::double as tu from p)
      select motif, methylated, unmethylated, case when unmethylated = 0 then null else round_even(methylated * tu / (tm * unmethylated), 4) end as enrichment from p, n""",
    "iupac_motif": f"with {READS} select read_idx from r where regexp_matches(seq, 'CG[CT][ACGT]|AAA[AG][AT]')",
    "truth_join": f"with {JOINED} select aligner, chrom, count(*) as sites, sum(called) as called, sum(methylated) as methylated from j group by 1, 2",
    "confusion_matrix": f"with {METRICS} select * from cm",
    "classification_metrics": f"with {METRICS} select * from m",
    "level_correlation": f"with {JOINED} select aligner, round_even(covar_pop(level, methylated) / (stddev_pop(level) * stddev_pop(methylated)), 4) as level_correlation from j group by 1",
    "aligner_status": f"with {METRICS}, names as (select distinct aligner from calls union all select 'absent'), n as (select aligner, count(*) as sites_called from cc group by 1) select aligner, sites_called, f1_score, case when sites_called is null then 'no_output' when sites_overlap is null then 'no_overlap' else 'ok' end as status from names left join n using (aligner) left join m using (aligner)",
    "rank_aligners": f"with {METRICS} select aligner, f1_score, row_number() over ({window}) as rank from m",
    "best_aligner": f"with {METRICS} select aligner, precision, recall, f1_score, accuracy, sites_overlap from m {window} limit 1",
    "flatten_results": f"with {RESULTS} select * from res",
    "best_per_sample": f"with {RESULTS} select sample, aligner, f1_score from res qualify row_number() over (partition by sample {window}) = 1",
    "overall_ranking": f"with {RESULTS}, s as (select aligner, {MEAN} as mean_f1, round_even(stddev_samp(f1_score), 6) as std_f1, count(*) as n from res group by 1) select *, row_number() over (order by mean_f1 desc, aligner) as rank from s",
    "wins_compat": f"with {RESULTS}, t as (select *, max(f1_score) over (partition by aligner) as top from res) select aligner, count(*) filter (f1_score = top) as wins from t group by 1",
    "sample_wins": f"with {RESULTS}, b as (select aligner from res qualify row_number() over (partition by sample {window}) = 1) select a.aligner, (select count(*) from b where b.aligner = a.aligner) as wins from (select distinct aligner from res) a",
    "rank_by_group": f"with {RESULTS}, s as (select grp, aligner, {MEAN} as mean_f1 from res group by 1, 2) select *, row_number() over (partition by grp order by mean_f1 desc, aligner) as rank from s",
    "rank_by_conversion": f"with {RESULTS}, s as (select conversion, aligner, {MEAN} as mean_f1 from res group by 1, 2) select *, row_number() over (partition by conversion order by mean_f1 desc, aligner) as rank from s",
    "pivot_f1": f"with {RESULTS} select sample, {', '.join(f'''round_even(sum((f1_score * 10000)::bigint) filter (aligner = '{a}')::double / (count(*) filter (aligner = '{a}') * 10000.0::double), 6) as {a}''' for a in ('mock_east', 'mock_north', 'mock_south', 'mock_west', 'seedconv'))} from res group by 1",
    "distinct_counts": f"with {RESULTS} select count(distinct sample) as n_sample, count(distinct aligner) as n_aligner, count(distinct grp) as n_grp, count(distinct conversion) as n_conversion from res",
    "unpivot_metrics": f"with {RESULTS} " + " union all ".join(f"select sample, aligner, '{c}' as metric, {c} as value from res" for c in ("precision", "recall", "f1_score", "accuracy")),
    "topk_aligners": f"with {RESULTS} select sample, aligner, f1_score from res order by f1_score desc, sample, aligner limit 5",
    "results_summary": f"with {RESULTS}, s as (select aligner, {MEAN} as mean_f1 from res group by 1 order by mean_f1 desc, aligner limit 1) select (select count(distinct sample) from res) as total_samples, (select count(distinct aligner) from res) as total_aligners, aligner as overall_best, mean_f1 as overall_best_f1, (select count(distinct sample) from res) as samples_with_best from s",
    "p5_found": f"with {LINES} select line_id, reason from told where reason is not null",
    "p5_errors": f"with {OFFSETS} select file_name, reason, count(*) as lines, min(line_no) as first_line, min(error_offset) as least_offset from spot join raw_calls using (line_id) group by 1, 2",
    "p5_valid": f"""with {LINES} select line_id, chrom, {", ".join(f'"{c}"::{"double" if c == "level" else "bigint"} as "{c}"' for c in P5_NAMES[1:])} from told where reason is null""",
}
ORACLES["perbase_file"] = ORACLES["perbase"]
ORACLES["bed7_scan"] = f'select chrom, pos as "start", pos + 1 as "end", level, meth_count, unmeth_count, coverage from ({ORACLES["call_ref_anchored"]})'
