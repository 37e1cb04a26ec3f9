"""The corpus queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.collocations import collocations
from tablewright.llm.common import Scratch, crc32_of_id, table
from tablewright.llm.conversations import repair_report
from tablewright.llm.decontamination import leaks
from tablewright.llm.html_text import extract_text
from tablewright.llm.licenses import STATEMENTS, scan_licenses
from tablewright.llm.minhash import NearDuplicates, near_duplicates
from tablewright.llm.mixing import Mixture, mix_sources
from tablewright.llm.packing import packed
from tablewright.llm.quality import fit_quality, score_quality
from tablewright.llm.quality_rules import (
    SYMBOLS,
    QualityRules,
    classes_sql,
    distance_sql,
    estimate_sql,
    nearest_sql,
    quality_rules,
    start_sql,
    statistics_sql,
)
from tablewright.llm.suffix_dedup import without_repeats
from tablewright.llm.token_counts import TokenizerFile, count_tokens
from tablewright.llm.toxicity import fit_toxicity, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


_NEAR_SQL = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
runs as (
  select doc_id, case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    when len(w) > 0 then [array_to_string(w, ' ') || ' /short'] else [] end as r from words),
s as (select distinct doc_id, unnest(r) as g from runs),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
sym as (select a, b from links union select b, a from links),
reach(doc_id, other) as (
  select doc_id, doc_id from documents union select reach.doc_id, sym.b from reach join sym on sym.a = reach.other)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, r.component_id, d.doc_id = r.component_id as kept
from documents d left join n on n.doc_id = d.doc_id
join (select doc_id, min(other) as component_id from reach group by doc_id) r on r.doc_id = d.doc_id
"""


@query("op1_near_duplicates", _NEAR_SQL)
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearDuplicates(shingle=4))


@query("op2_repeated_passages")
def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), digest=True)


def _scored(scored: DataFrame, folds: int, fold: int) -> DataFrame:
    held_out = crc32_of_id("doc_id") % folds == fold
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), crc32_of_id("doc_id") % 5 != 0)
    return _scored(score_toxicity(docs, model), 5, 0)


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), crc32_of_id("doc_id") % 3 != 1)
    return _scored(score_quality(docs, model), 3, 1)


def _rules_sql() -> str:
    """The base counts in SQL of their own; the estimate by the steps that the operator runs, as one chain of CTEs."""
    rules = QualityRules()
    steps = []
    for i in range(rules.steps):
        steps.append(f"n{i} as ({nearest_sql(distance_sql('learn', f'e{i}'))})")
        steps.append(f"e{i + 1} as ({estimate_sql(distance_sql('learn', f'e{i}'), f'n{i}')})")
    return rf"""
with d as (select doc_id, lang || chr(1) || source as own, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
run as (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w),
twice as (select doc_id, i from run qualify count(*) over (partition by doc_id, w[i:i + 4]) > 1),
covered as (select doc_id, count(distinct i + o) as n from twice, range(5) r(o) group by doc_id),
base as (select w.doc_id, own, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint as n_symbols, len(lines)::bigint as n_lines,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words from w left join covered using (doc_id)),
measured as (select *, n_words < {rules.least_words} or 100 * n_repeat_words > {rules.most_repeated} * n_words as base_failed,
  case when count(*) over (partition by own) >= {rules.least_group} then own else chr(2) end as g, {", ".join(statistics_sql())} from base),
learn as (select g, x0, x1, x2, x3 from measured where not base_failed and g <> chr(2) union all select chr(2), x0, x1, x2, x3 from measured where not base_failed),
classes as ({classes_sql("learn")}),
e0 as ({start_sql("classes")}),
{", ".join(steps)},
done as ({distance_sql("measured", f"e{rules.steps}").replace(f" join e{rules.steps}", f" left join e{rules.steps}")})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(d, 0) <= {rules.cut} as kept from done
"""


@query("op8_quality_rules", _rules_sql())
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("distance")


_WORDS_SQL = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

_LEAKS_SQL = f"""
with d as (select doc_id, {_WORDS_SQL} as w from documents), b as (select item_id, {_WORDS_SQL} as w from benchmark),
masks(m) as (values ([0, 1, 3, 4, 7]), ([0, 2, 3, 6, 7])),
dp as (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d), bp as (select item_id, w, unnest(range(1, len(w) - 6)) as i from b),
ds as (select doc_id, i, m, list_transform(m, lambda o: w[i + o]) as s from dp, masks),
bs as (select item_id, i, m, list_transform(m, lambda o: w[i + o]) as s from bp, masks),
hits as (select distinct doc_id, item_id, ds.i - bs.i as diagonal from ds join bs on ds.m = bs.m and ds.s = bs.s),
laid as (select doc_id, item_id, diagonal, len(b.w) as n_item, least(len(b.w), 13) as win,
  list_transform(range(1, len(b.w) + 1), lambda j: case when diagonal + j >= 1 and d.w[diagonal + j] = b.w[j] then 1 else 0 end) as e
  from hits join d using (doc_id) join b using (item_id)),
scored as (select *, list_sum(e) as n_equal, list_max(list_transform(range(1, len(e) - win + 2), lambda i: list_sum(e[i:i + win - 1]))) as best from laid),
ranked as (select *, row_number() over (partition by doc_id, item_id order by n_equal desc, best desc, diagonal) as r from scored where 100 * best >= 80 * win)
select doc_id, item_id, cast(n_equal as bigint) as n_equal, cast(n_item as bigint) as n_item, cast(best as bigint) as best, cast(win as bigint) as "window",
  cast(diagonal as bigint) as first_word from ranked where r = 1
"""


@query("op6_benchmark_leaks", _LEAKS_SQL)
def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_STATEMENT_ROWS = ", ".join("({}, '{}', '{}')".format(i, label, text.replace("'", "''")) for i, (label, text) in enumerate(STATEMENTS))
_LICENSES_SQL = f"""
with d as (select doc_id, {_WORDS_SQL} as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
places as (select doc_id, i - 1 as spot, case when w[i] = 'general' then 'gpl' else w[i] end as label from p
  where (w[i] in ('mit', 'apache') and w[i + 1] = 'license') or (w[i] = 'general' and w[i + 1] = 'public' and w[i + 2] = 'license')),
base as (select doc_id, count(*) as n_base, min(spot) as first_word, max(spot) as last_word, list_sort(list_distinct(list(label))) as labels from places group by doc_id),
known(statement, label, text) as (values {_STATEMENT_ROWS}),
k as (select statement, label, {_WORDS_SQL} as w from known),
kp as (select statement, label, len(w) as n, len(w) - 2 as n_runs, w, unnest(range(1, len(w) - 1)) as place from k),
kr as (select *, w[place:place + 2] as run from kp),
hits as (select doc_id, statement, label, n, n_runs, i as spot, place, i - place as diagonal from p join kr on p.w[i:i + 2] = kr.run),
opened as (select *, case when coalesce(diagonal - lag(diagonal) over (partition by doc_id, statement order by diagonal), 99) > 3 then 1 else 0 end as opens from hits),
grouped as (select *, sum(opens) over (partition by doc_id, statement order by diagonal range unbounded preceding) as c from opened),
found as (select doc_id, label, count(distinct place) as runs, count(distinct place + o) as covered, n, n_runs, max(spot) + 2 - min(spot) + 1 as wide, max(place) + 2 as upto
  from grouped, range(3) r(o) group by doc_id, statement, label, n, n_runs, c),
more as (select doc_id, list(label) as labels, max(greatest(runs / n_runs, covered / n)) as share from found
  where (100 * runs >= 80 * n_runs or (n >= 10 and 100 * covered >= 80 * n)) and (n > 16 or upto = n) and 100 * wide <= 150 * n group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  array_to_string(coalesce(base.labels, []), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') as labels,
  case when n_base > 0 then 1.0 else coalesce(share, 0.0) end::double as score
from d left join base using (doc_id) left join more using (doc_id)
"""


@query("op10_licenses", _LICENSES_SQL)
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("copies")


def _narrowed_sql(name: str, fits: str) -> str:
    """The turns of narrowing the exponent, as one CTE each; sources(p) has the token shares."""
    turns = [f"{name}0 as (select 0.0::double as low, 1.0::double as high)"]
    for i in range(Mixture.turns):
        sums = f"""select i, sum(pow(p, a)) as z, sum(pow(p, a) * a * ln(p)) as w, max(pow(p, a - 1)) as top
            from (select p, i, low + i * ((high - low) / {Mixture.points}) as a from sources, {name}{i}, range({Mixture.points + 1}) r(i)) group by i"""
        last = f"coalesce((select max(i) from ({sums}) where {fits}), 0)"
        moved = f"select low + {last} * ((high - low) / {Mixture.points}) as low, (high - low) / {Mixture.points} as step from {name}{i}"
        turns.append(f"{name}{i + 1} as (select low, least(low + step, 1.0) as high from ({moved}))")
    return ",\n".join(turns)


_MIX_SQL = f"""
with d as (select doc_id, source, md5('{Mixture.seed}:' || doc_id) as k,
    cast(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as bigint) as n from documents),
totals as (select source, sum(n)::bigint as tokens from d group by source),
sources as (select tokens / (select sum(tokens) from totals)::double as p from totals where tokens > 0),
{_narrowed_sql("e", f"ln(z) - w / z >= {Mixture.entropy} * ln((select count(*) from sources))")},
{_narrowed_sql("t", f"top / z * {Mixture.budget} > {Mixture.most_passes}")},
chosen as (select greatest((select low from e{Mixture.turns}), (select low from t{Mixture.turns})) as a),
shares as (select source, tokens, floor(pow(tokens::double, a) / (select sum(pow(tokens::double, a)) from totals, chosen) * 1e9)::hugeint as share from totals, chosen),
budgets as (select source, tokens, (share * (select sum(tokens) from totals)::hugeint) // 1000000000 as budget from shares),
ranked as (select d.*, budget // tokens as passes, budget % tokens as rest,
    sum(n) over (partition by source order by k range unbounded preceding) as upto from d join budgets using (source)),
copies as (select *, unnest(range(0, cast(passes + case when upto <= rest then 1 else 0 end as bigint))) as copy from ranked)
select doc_id, source, n as n_tokens, copy, md5('{Mixture.seed}:' || copy || ':' || doc_id) as shuffle_key from copies
"""


@query("op4_source_mixture", _MIX_SQL)
def op4_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "n_tokens", "copy", "shuffle_key")


def public_tokenizer(name: str) -> TokenizerFile:
    import public_tokenizers

    return TokenizerFile.read(public_tokenizers.path(name), getattr(public_tokenizers, "PATTERN", None) if name.endswith(".tiktoken") else None)


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of its own for each call: the query's work must not depend on what ran before it.
    cache = f"{Scratch(spark, 'token-cache').folder}/counts"
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"), cache)


@query("op7_html_text")
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


_COLLOCATIONS_SQL = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
totals as (select lang, sum(len(w))::hugeint as n from w group by lang),
runs as (select lang, size, array_to_string(w[i:i + size - 1], ' ') as phrase
  from (select lang, size, w, unnest(range(1, len(w) - size + 2)) as i from w, range(1, 6) r(size))),
f as (select lang, size, phrase, count(*)::hugeint as f from runs group by all having count(*) >= 100),
cand as (select *, string_split(phrase, ' ') as w from f where size > 1),
inside as (select distinct lang, array_to_string(w[i:i + size - 1], ' ') as phrase, f
  from (select c.*, r.size as longer, unnest(range(1, c.size - r.size + 2)) as i, r.size from cand c, range(2, 5) r(size) where r.size < c.size) t(lang, whole, p, f, w, longer, i, size)),
kept as (select c.* from cand c where not exists (select 1 from inside i where i.lang = c.lang and i.phrase = c.phrase and 100 * i.f >= 100 * c.f)),
cuts as (select kept.lang, kept.phrase, kept.f as a, n, k, x.f as l, y.f as r, 1000 * kept.f * n // (x.f * y.f) as score
  from kept, range(1, 5) r(k), f x, f y, totals where k < kept.size and x.lang = kept.lang and y.lang = kept.lang and totals.lang = kept.lang
    and x.phrase = array_to_string(kept.w[1:k], ' ') and y.phrase = array_to_string(kept.w[k + 1:], ' ')),
best as (select *, row_number() over (partition by lang, phrase order by score, k) as i from cuts),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best where i = 1)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= 2000
"""


@query("op13_collocations", _COLLOCATIONS_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def _repair_sql() -> str:
    """Costs and least audits from the last turn to the first, as text: nine digits of cost, then the letters; x where no edits lead on."""

    def paid(value: str, cost: str, letter: str) -> str:
        return f"case when {value} = 'x' then 'x' else lpad((left({value}, 9)::bigint + {cost})::varchar, 9, '0') || '{letter}' || substr({value}, 10) end"

    def best(state: str) -> str:
        turn = "va" if state == "vu" else "vu"
        keeps = {"v0": "when initial = 's' then vs when initial = 'u' then vu", "vu": "when initial = 'a' then va"}.get(state, "when initial = 'u' then vu")
        kept = f"(case when must_go then 'x' {keeps} else 'x' end)"
        moved = f"(case when must_go then 'x' else {turn} end)"
        return f"least({paid(state, '4', 'D')}, {paid(kept, 'extra', 'K')}, {paid(moved, '3 + extra', 'R')}) as {state}"

    return rf"""
with recursive given as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''),
    lambda c: [ord(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))) as crc from conversations),
fated as (select *, xor(crc, 4294967295) % 20 as fate from given),
after as (select conv_id, turn, case when fate = 4 then 'user' else role end as role,
  case fate when 1 then '' when 2 then translate(text, '.!?', '') else text end as text from fated, range(2) r(copy) where fate <> 0 and (copy = 0 or fate = 3)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, left(text, 64), md5(text)) as i from after),
judged as (select *, left(role, 1) as initial, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) as last,
  row_number() over (partition by conv_id, role, text order by i) > 1 as again, lag(left(role, 1)) over (partition by conv_id order by i) as before from placed),
t as (select *, last = '' as blank, last <> '' and again as duplicate, last <> '' and not again and last not in ('.', '!', '?') as truncated from judged),
u as (select *, blank or duplicate as must_go, case when truncated then 3 else 0 end as extra from t),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(blank) as blank, count_if(duplicate) as duplicate,
  count_if(truncated) as truncated, count_if(before is not null and before || initial not in ('su', 'ua', 'au')) as illegal, max(i) as n from u group by conv_id),
back as (select conv_id, n + 1 as i, '000000000' as v0, '000000006II' as vs, '000000003I' as vu, '000000000' as va from counts
  union all select conv_id, i, least(v0, {paid("nu", "3", "I")}), least(vs, {paid("nu", "3", "I")}), nu, least(va, {paid("nu", "3", "I")})
  from (select *, least(vu, {paid("va", "3", "I")}) as nu from (select u.conv_id, u.i, {", ".join(best(s) for s in ("v0", "vs", "vu", "va"))}
    from back join u on u.conv_id is not distinct from back.conv_id and u.i = back.i - 1))),
found as (select conv_id, left(v0, 9)::bigint as cost, substr(v0, 10) as audit from back where i = 1),
walk as (select conv_id, audit, 1 as spot, 1::bigint as i, '' as state, []::varchar[] as lines from found
  union all select w.conv_id, audit, spot + 1, case when e = 'I' then w.i else w.i + 1 end,
    case e when 'D' then state when 'K' then initial else other end,
    case e when 'D' then lines when 'I' then list_append(lines, other_role || ':') when 'K' then list_append(lines, role || ':' || text) else list_append(lines, other_role || ':' || text) end
  from (select *, substr(audit, spot, 1) as e, case when state = 'u' then 'a' else 'u' end as other, case when state = 'u' then 'assistant' else 'user' end as other_role from walk) w
    left join u on u.conv_id is not distinct from w.conv_id and u.i = w.i where spot <= length(audit)),
every as (select distinct conv_id from conversations)
select every.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(f.cost, 0)::bigint as cost, coalesce(f.audit, '') as audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) as repaired_sha256
from every left join counts c on c.conv_id is not distinct from every.conv_id left join found f on f.conv_id is not distinct from every.conv_id
  left join (select * from walk where spot > length(audit)) w on w.conv_id is not distinct from every.conv_id
"""


@query("op12_conversation_repair", _repair_sql())
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


@query("op11_packed_sequences")
def op11_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"))
