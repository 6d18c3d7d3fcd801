"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from ..operators.configs import ALIASES

#: Splits, and lengths of reports.
N_SPLITS, KS = 100, (50, 100, 200)

# word vectors, lists, splits and neighbours, as in queries.Fixture
_VECS = """raw as (select 'w' || vec_id word, [x::double for x in embedding] e, label::int label from embeddings),
vecs as (select word, [x / n for x in e] v, label from (select *, sqrt(list_dot_product(e, e)) n from raw)),
glossary as (select a.word from vecs a, vecs b where b.word = 'w0' and round(list_dot_product(a.v, b.v), 10) >= 0.15),
stop as (select word from raw where label = 0 and word not in (from glossary))"""
_NBR = """pairs as (select a.word query, b.word nword, round(list_dot_product(a.v, b.v), 10) cossim from vecs a, vecs b where a.word <> b.word),
nbr as (select *, round(1 - cossim, 10) distance from (select *, row_number() over (partition by query order by cossim desc, nword) rank from pairs) where rank <= 20),
lnbr as (select n.*, (nword in (from glossary))::int nlabel from nbr n),
labels_ as (select word, (word in (from glossary))::int label from raw)"""


def _splits(name: str, words: str, strata: str = "", ratio: float | None = None) -> str:
    """A CTE of seeded splits of the words of a query (word[, label])."""
    s = f", {strata}" if strata else ""
    kept = f"(select * from (select *, sum({strata or '0'}) over (partition by split_id) npos from {name}_r) where label = 1 or rn <= floor(npos * {ratio}))" if ratio else f"{name}_r"
    return f"""{name}_w as ({words}),
{name}_r as (select split_id, word{s}, row_number() over (partition by split_id{s} order by md5(concat_ws('/', 42, split_id, word)), word) rn from {name}_w, (select unnest(range({N_SPLITS}))::int split_id)),
{name} as (select split_id, case when rn <= floor(n * 0.8) then 'ref' when rn <= floor(n * 0.8) + floor(n * 0.1) then 'dev' else 'test' end part, word{s}
  from (select *, count(*) over (partition by split_id{s}) n from {kept}))"""


_SPLITS = _splits("splits", "select word from glossary")
_STRATA = _splits("strat", "select word, label from labels_", "label")
_POOLS = """positive as (select distinct split_id, part, word, 1 label from splits where part <> 'ref' and word in (select word from {words})),
background as (select distinct word from {words} where word not in (select word from splits) and word not in (from stop)),
pool as (select * from positive union all select split_id, part, word, 0 from background, (select distinct split_id from splits), (select unnest(['dev', 'test']) part))"""
_CENTROID = """cells as (select split_id, unnest(range(1, 65)) dim, v from splits join vecs using (word) where part = 'ref'),
cmean as (select split_id, list(x order by dim) c from (select split_id, dim, avg(v[dim]) x from cells group by all) group by split_id),
centre as (select split_id, [x / sqrt(list_dot_product(c, c)) for x in c] c from cmean where list_dot_product(c, c) > 0),
csims as (select split_id, word, round(list_dot_product(v, c), 10) csim from vecs, centre)"""


def _q(body: str, *parts: str) -> str:
    return f"with {', '.join(parts)} {body}"


def _curves(groups: str, keys: str) -> str:
    """CTEs points and summary of a relation (keys, score, np, nn)."""
    return f"""points as (select *, tp::double / nullif(pos, 0) tpr, fp::double / nullif(neg, 0) fpr, tp::double / (tp + fp) as "precision", tp::double / nullif(pos, 0) recall from
  (select *, sum(np) over (partition by {keys} order by score desc)::bigint tp, sum(nn) over (partition by {keys} order by score desc)::bigint fp,
          sum(np) over (partition by {keys})::bigint pos, sum(nn) over (partition by {keys})::bigint neg from {groups})),
scored_points as (select *, tpr - fpr j, 2 * "precision" * recall / ("precision" + recall + 1e-12) f1 from points),
summary as (select {keys}, pos, neg, sum((tp - np / 2.0::double) * nn) / nullif(pos::double * neg, 0) roc_auc,
  case when pos::double * neg > 0 then sum(np * "precision") / pos end average_precision,
  case when max(j) > 0 then (list(score order by j desc, score desc) filter (j is not null))[1] else 'inf'::double end ba_threshold,
  (list(score order by f1 desc, score))[1] f1_threshold, (list("precision" order by f1 desc, score))[1] f1_precision,
  (list(recall order by f1 desc, score))[1] f1_recall, max(f1) f1_best from scored_points group by {keys}, pos, neg)"""


_SUMMARY = "pos, neg, round(roc_auc, 6) roc_auc, round(average_precision, 6) average_precision, round(ba_threshold, 6) ba_threshold, round(f1_threshold, 6) f1_threshold, round(f1_precision, 6) f1_precision, round(f1_recall, 6) f1_recall, round(f1_best, 6) f1_best"
_SCORED = """scored as (select user_id % 10 as "key", event_id, round(value) score, (event_type = 'purchase')::int label from events),
groups as (select "key", score, sum(label)::bigint np, sum(1 - label)::bigint nn from scored group by all)"""
_RANKS = """select "key", k, size, pos, tp, round("precision", 6) as "precision", round(recall, 6) recall, round(specificity, 6) specificity,
 round(case when "precision" + recall > 0 then 2 * "precision" * recall / ("precision" + recall) else 0 end, 6) f1 from
 (select "key", k::int k, size, pos, tp, tp::double / least(k, size) as "precision", coalesce(tp::double / nullif(pos, 0), 0) recall,
   coalesce((size - pos - (least(k, size) - tp))::double / nullif(size - pos, 0), 0) specificity from
  (select "key", k, count(*) size, sum(label)::bigint pos, sum(case when rn <= k then label else 0 end)::bigint tp from ranked, (select unnest({ks}) k) group by "key", k))"""
_LOG = r"""ev as (select *, 'run' || (user_id % 4) run, dayofmonth(ts) d, min(value) over (partition by user_id % 4 order by event_id rows between unbounded preceding and 1 preceding) b from events),
le as (select run, event_id line, case when event_type = 'click' then 'metric' when event_type = 'purchase' then 'accept' when event_type = 'view' and (b is null or value < b) then 'best' else 'round' end kind,
  'c' || user_id c, d, printf('%.4f', -value)::double v from ev),
log_events as (select run, line, kind, case when kind in ('metric', 'accept') then c end site, case when kind <> 'metric' then d::int end round, case when kind in ('metric', 'best') then v end value from le),
br as (select *, sum(case kind when 'metric' then 1 else -1 end) over (partition by run, site order by line) b from log_events where kind in ('metric', 'accept')),
br2 as (select *, least(0, min(b) over (partition by run, site order by line)) low, least(0, coalesce(min(b) over (partition by run, site order by line rows between unbounded preceding and 1 preceding), 0)) before from br),
br3 as (select *, b - low + (kind = 'accept')::int depth from br2 where not (kind = 'accept' and b < before)),
pairs_ as (select run, site, line, round, partner value from (select *, lag(value) over (partition by run, site, depth order by line) partner from br3) where kind = 'accept'),
log_metrics as (select run log_label, 'site:' || site series, round, value validation_metric from pairs_ union all select run, 'global_best', round, value from log_events where kind = 'best')"""
_PERF = """perf as (select * from (select 'run' || (user_id % 4) run, dayofmonth(ts)::int round, round(avg(value) filter (event_type = 'view'), 6) dev_ppl, round(avg(value) filter (event_type = 'signup'), 6) test_ppl from events group by all) where dev_ppl is not null and test_ppl is not null)"""
_NESTED = """hoods as (select 'f' || (vec_id % 4) src, vec_id pos, l.word, l.label, coalesce(x, []) neighbours from (select vec_id, 'w' || vec_id word from embeddings) e join labels_ l using (word)
  left join (select query word, list({'cossim': cossim, 'word': nword, 'label': nlabel} order by rank) x from lnbr where cossim > 0.2 group by query) using (word)),
flat as (select src, pos, word query, label, unnest(range(1, len(neighbours) + 1))::int rank, neighbours from hoods)"""
_FLAT = "select src, pos, query, label, rank, neighbours[rank].word nword, neighbours[rank].label nlabel, round(neighbours[rank].cossim, 6) cossim from"
_VOTES = """wts as (select *, unnest(['constant', 'inverse', 'exponential']) weight_type from lnbr),
wt as (select *, case weight_type when 'constant' then 1 when 'inverse' then 1 / (distance + 1e-5) else exp(-distance) end::double w from wts),
votes as (select query, weight_type, rank::int n, sum(w * nlabel) over p vote, sum(w * nlabel) over p / (sum(w) over p + 1e-12) vote_norm from wt window p as (partition by query, weight_type order by rank)),
dists as (select query, rank::int n, coalesce(-min(case when nlabel > 0 then distance end) over p, -1e9) mindist, coalesce(-avg(case when nlabel > 0 then distance end) over p, -1e9) avgdist,
  avg(distance) over p central_mean, quantile_cont(distance, 0.5) over p central_median from lnbr window p as (partition by query order by rank))"""


def _select_and_test(keys: str, prefer: str, on: str = "ba", within: str = "", default: float = 0.0) -> str:
    """CTEs from scores (split_id, keys, query, score) and pool to result, in the form of pipelines.select_and_test."""
    at = f"split_id, {keys}"
    part = f"split_id, {within}" if within else "split_id"
    return f"""sc as (select s.split_id, p.part, {keys}, p.word, p.label, s.score from scores s join pool p on p.split_id = s.split_id and p.word = s.query),
g0 as (select split_id, part, {keys}, score, sum(label)::bigint np, sum(1 - label)::bigint nn from sc group by all),
totals as (select split_id, part, sum(label)::bigint p, sum(1 - label)::bigint n_ from pool group by all),
rest as (select t.split_id, t.part, {keys}, {default}::double score, t.p - coalesce(s.p, 0) np, t.n_ - coalesce(s.n_, 0) nn from totals t cross join (select distinct {keys} from scores)
  left join (select split_id, part, {keys}, sum(np) p, sum(nn) n_ from g0 group by all) s using (split_id, part, {keys})),
groups as (select split_id, part, {keys}, score, sum(np)::bigint np, sum(nn)::bigint nn from (from g0 union all (from rest where np > 0 or nn > 0)) group by all),
{_curves('groups', f'split_id, part, {keys}')},
chosen as (select * from (select {at}, roc_auc dev_roc_auc, {on}_threshold threshold, row_number() over (partition by {part} order by roc_auc desc, {prefer}) rn from summary where part = 'dev' and roc_auc is not null) where rn = 1),
cut as (select {at}, sum(case when score > threshold then np else 0 end) tp, sum(case when score > threshold then nn else 0 end) fp, sum(case when score > threshold then 0 else np end) fn, sum(case when score > threshold then 0 else nn end) tn
  from groups join chosen using ({at}) where part = 'test' group by all),
ranked as (select {at}, label, row_number() over (partition by {at} order by coalesce(score, {default}) desc, word) rn, count(*) over (partition by {at}) size from
  (select c.split_id, {', '.join('c.' + k.strip() for k in keys.split(','))}, p.word, p.label, s.score from chosen c join pool p on p.split_id = c.split_id and p.part = 'test'
   left join scores s on s.split_id = c.split_id and s.query = p.word and {' and '.join(f's.{k.strip()} = c.{k.strip()}' for k in keys.split(','))})),
tops as (select {at}, {', '.join(f'sum(label) filter (rn <= {k}) / least({k}, max(size)) p{k}' for k in KS)} from ranked group by {at}),
result as (select {at}, round(dev_roc_auc, 6) dev_roc_auc, round(threshold, 6) threshold, round(roc_auc, 6) roc_auc, round(average_precision, 6) average_precision,
  round(case when same then f1_precision else coalesce(tp::double / nullif(tp + fp, 0), 0) end, 6) as "precision", round(case when same then f1_recall else coalesce(tp::double / nullif(tp + fn, 0), 0) end, 6) recall,
  round(case when same then f1_best else coalesce(2.0 * tp::double / nullif(2 * tp + fp + fn, 0), 0) end, 6) f1, {', '.join(f'round(p{k}, 6)::double precision_at_{k}' for k in KS)}
  from summary join chosen using ({at}) join (select *, tp + fp = 0 or fn + tn = 0 same from cut) using ({at}) join tops using ({at}) where part = 'test' and roc_auc is not null)"""


_ORDER = "list_position(['constant', 'inverse', 'exponential'], weight_type), n"
_LIST = """hits as (select s.split_id, n.query, n.rank, n.distance, unnest({weights}) weight_type from nbr n join splits s on s.word = n.nword and s.part = 'ref'),
spread as (select *, unnest(range(rank, 21))::int n, case weight_type when 'constant' then 1 when 'inverse' then 1 / (distance + 1e-5) else exp(-distance) end::double w from hits),
scores as (select split_id, weight_type, n, query, round({score}, 10) score from spread group by all)"""


def _list(mode: str) -> str:
    weights = "['constant', 'inverse', 'exponential']" if mode == "vote" else "['constant']"
    score = {"vote": "sum(w)", "mindist": "-min(distance)", "avgdist": "-avg(distance)"}[mode]
    return _q("from result", _VECS, _NBR, _SPLITS, _POOLS.format(words="raw"), _LIST.format(weights=weights, score=score), _select_and_test("weight_type, n", _ORDER, default=0.0 if mode == "vote" else -1e9))


_STRAT_POOL = "pool as (select split_id, part, s.word, l.label from strat s join labels_ l using (word) where part <> 'ref'), all_splits as (select distinct split_id from strat)"
_VOTE_GROUPS = "vs as (select v.*, round(vote, 10) score, l.label from votes v join labels_ l on l.word = v.query), groups as (select weight_type, n, score, sum(label)::bigint np, sum(1 - label)::bigint nn from vs group by all)"
_GSIMS = "gs as (select a.word, b.word gword, round(list_dot_product(a.v, b.v), 10) cossim from vecs a, vecs b where b.word in (from glossary))"
_RESULTS = f"""{_SCORED}, {_curves('groups', '"key"')},
results as (select "key", 'roc_auc' metric, roc_auc value from summary union all select "key", 'average_precision', average_precision from summary)"""
_CENT_RES = f"""{_VECS}, {_SPLITS}, {_CENTROID}, {{pools}}, tp0 as (select split_id, word, label, csim from pool join csims using (split_id, word) where part = 'test' {{extra}}),
groups as (select split_id, csim score, sum(label)::bigint np, sum(1 - label)::bigint nn from tp0 group by all), {_curves('groups', 'split_id')},
rk as (select *, row_number() over (partition by split_id order by csim desc, word) rn, count(*) over (partition by split_id) size from tp0),
cres as (select split_id, k::int k, pos, neg, roc_auc, average_precision, p as "precision" from summary join (select split_id, k, sum(case when rn <= k then label else 0 end)::double / least(k, max(size)) p from rk, (select unnest([50, 100, 200]) k) group by split_id, k) using (split_id) where pos > 0)"""
_TOKENS = r"""docs_ as (select id, [x for x in regexp_split_to_array(lower(trim(text, ' ')), '\s+') if x <> ''] t from (select concat_ws('/', conv_id, turn) id, text from conversations)),
toks as (select id, pos - 1 pos, t[pos] token from (select id, t, unnest(range(1, len(t) + 1)) pos from docs_))"""
_GRAM_WEIGHTS = r"""padded as (select word, ' ' || unnest([x for x in regexp_split_to_array(lower(word), '\s+') if x <> '']) || ' ' p from (select word from names union select word from refs)),
gr as (select word, substr(p, i, n) ngram from (select word, p, n, unnest(range(1, greatest(length(p) - n + 1, 1) + 1)) i from padded, (select unnest([2, 3, 4]) n) where n = 2 or length(p) >= n)),
tf as (select word, ngram, count(*) tf from gr group by all), df as (select ngram, count(*) df from tf where word in (from names) group by all),
x0 as (select word, ngram, tf * (ln((1.0::double + (select count(distinct word) from tf where word in (from names))) / (1.0 + df)) + 1.0) x from tf join df using (ngram)),
wn as (select word, ngram, x / sqrt(sum(x * x) over (partition by word)) w from x0)"""
_GRAMS = f"names as (select distinct p_name word from part), refs as (select distinct p_brand brand, p_name word from part), {_GRAM_WEIGHTS}"
_DRAWS = "nb as (select metric, value x, row_number() over (partition by metric order by value) - 1 i, count(*) over (partition by metric) n from results), dr as (select metric, n, b, unnest(range(n)) d from (select distinct metric, n from nb), (select unnest(range(10000)) b)), di as (select metric, b, ('0x' || substr(md5(concat_ws('/', 42, b, d)), 1, 15))::bigint % n i from dr), ms as (select metric, b, avg(x) m from di join nb using (metric, i) group by all)"

_SW = f"""splits as (select 0 split_id, 'ref' part, word from glossary), {_CENTROID},
gb as (select a.word, case when a.word = b.word then -1.0 else round(list_dot_product(a.v, b.v), 10) end::double cossim from vecs a, vecs b where b.word in (from glossary)),
sw as (select word, max(cossim) mindist_all, avg(cossim) avgdist_all, list_sum((list(cossim order by cossim desc))[1:10]) votetopk_all, any_value(csim) centroid, ln(1 + 3.0::double * any_value(label)) log_count from gb join csims using (word) join raw using (word) group by word)"""
_USED = """bg as (select distinct split_id, b.word from background b, splits),
size as (select split_id, count(*) filter (part = 'ref') "ref", count(*) filter (part = 'dev') dev, count(*) filter (part = 'test') test from splits group by split_id),
used as (select split_id, word from (select *, row_number() over (partition by split_id order by md5(concat_ws('/', 42, 'train', split_id, word)), word) rn from bg) join size using (split_id) where rn <= 2 * "ref"
 union select split_id, word from (select *, row_number() over (partition by split_id order by csim, word) rn from csims join bg using (split_id, word)) join size using (split_id) where rn <= 2 * "ref")"""

_FEATURES = ("vote", "mindist", "avgdist", "cnt", "centroid", "mindist_all", "avgdist_all", "votetopk_all", "lexical")
_FEATS = f"""names as (select word from raw), refs as (select distinct word from splits where part = 'ref'), {_GRAM_WEIGHTS},
graph as (select split_id, query word, sum(cossim) vote, max(cossim) mindist, avg(cossim) avgdist, count(*) cnt from nbr join splits on splits.word = nword where part = 'ref' group by all),
fullf as (select s.split_id, gs.word, max(cossim) mindist_all, avg(cossim) avgdist_all, list_sum((list(cossim order by cossim desc))[1:10]) votetopk_all from gs join splits s on s.word = gword where part = 'ref' group by s.split_id, gs.word),
lexs as (select a.word, b.word rword, round(sum(a.w * b.w), 10) sim from wn a join wn b using (ngram) where b.word in (select word from refs) group by all),
lexf as (select split_id, lexs.word, max(sim) lexical from lexs join splits s on s.word = rword where part = 'ref' group by split_id, lexs.word),
feat as (select split_id, word, {', '.join(f'round(coalesce({"csim" if c == "centroid" else c}, 0)::double, 10) {c}' for c in _FEATURES)} from csims left join graph using (split_id, word) left join fullf using (split_id, word) left join lexf using (split_id, word))"""
_TRAIN = """bg as (select distinct split_id, b.word from background b, splits), size as (select split_id, count(*) n from splits where part = 'ref' group by split_id),
rnd as (select split_id, word from (select *, row_number() over (partition by split_id order by md5(concat_ws('/', 42, 'train', split_id, word)), word) rn from bg) join size using (split_id) where rn <= 2 * n),
rel as (select split_id, word from (select *, row_number() over (partition by split_id order by csim, word) rn from csims join bg using (split_id, word)) join size using (split_id) where rn <= 2 * n),
tr as (select split_id, clf, word, 1 as "label" from splits, (select unnest(['pu_lr', 'pu_rn']) clf) where part = 'ref' union all select split_id, 'pu_lr', word, 0 from rnd union all select split_id, 'pu_rn', word, 0 from rel)"""


def _z(c: str) -> str:
    return f"({c} - avg({c}) over w) / (case when stddev_pop({c}) over w = 0 then 1 else stddev_pop({c}) over w end)"


def _given(sign: float) -> str:
    """The probability by the classifiers that queries._given gives."""
    terms = " + ".join(f"({c} - {0.1 * (i % 3)}::double) / {0.5 + 0.25 * (i % 2)}::double * (0.5::double - {0.125 * i}::double + 0.0625::double * split_id) * ({sign}::double)" for i, c in enumerate(_FEATURES))
    return f"1 / (1 + exp(-(-0.25::double + {terms})))"


_GIVEN = f"""hyb as (select *, round({_z('vote')} + {_z('centroid')} + {_z('lexical')}, 10) hybrid, {_given(1.0)} pu_lr, {_given(-0.5)} pu_rn from feat window w as (partition by split_id)),
evp as (select h.*, 1 y from hyb h join splits s using (split_id, word) where s.part = 'test' union all select h.*, 0 from hyb h join bg using (split_id, word) where (split_id, word) not in (select split_id, word from tr where "label" = 0)),
long as (select split_id, word, y, method, score from (select *, unnest({[*_FEATURES, 'hybrid', 'pu_lr', 'pu_rn']}) method, unnest([{', '.join('ln(1 + cnt)' if c == 'cnt' else c for c in [*_FEATURES, 'hybrid', 'pu_lr', 'pu_rn'])}]) score from evp) where method <> 'cnt'),
groups as (select split_id, method, score, sum(y)::bigint np, sum(1 - y)::bigint nn from long group by all),
rk as (select *, row_number() over (partition by split_id, method order by score desc, md5(concat_ws('/', 42, 'ties', split_id, word)), word) rn from long)"""

_MASTER = """mw as (select word from raw where label in (1, 3) union select 'no-' || word from raw where label = 5),
cls as (select word, label from labels_ union all select word, 1 - label from labels_ where word like '%3'),
maj as (select word, case when sum(label) > count(label) / 2 then 1 else 0 end::int as label from cls group by word),
master as (select word, label from mw left join maj using (word) where word not in (from stop))"""

ORACLES: dict[str, str] = {
    "s13_knn": _q("select query, rank::int rank, nword, round(cossim, 6) cossim from nbr", _VECS, _NBR),
    "s13_knn_cells": "select count(*) * 20 listed, count(*) queries, true enough, true fewer from embeddings",
    "s1_explode_neighbours": _q(f"{_FLAT} flat where rank <= 10", _VECS, _NBR, _NESTED),
    "p4_skip_labels": _q(f"{_FLAT} flat where rank <= 5 and label <> 1", _VECS, _NBR, _NESTED),
    "a2_neighbour_limit": _q("select min(len(neighbours))::int neighbour_limit from hoods where len(neighbours) > 0", _VECS, _NBR, _NESTED),
    "p8_first_long_enough": _q(f"{_FLAT} (select * replace ('a' as src) from flat where len(neighbours) >= 4) where rank <= 4", _VECS, _NBR, _NESTED),
    "p1_unit_vectors": _q("select word, (d - 1)::int dim, round(v[d], 6) + 0.0 x from (select word, v, unnest(range(1, 65)) d from vecs)", _VECS),
    "p2_scrub": "with c as (select vec_id, [case when (vec_id + i - 1) % 7 = 0 then 0 else embedding[i]::double end for i in range(1, 65)] v, len([i for i in range(1, 65) if (vec_id + i - 1) % 7 = 0])::int n_bad from embeddings) select vec_id, n_bad, round(sqrt(list_dot_product(v, v)), 6) norm from c",
    "w1_prefix_votes": _q("select query, weight_type, n, round(vote, 6) vote, round(vote_norm, 6) vote_norm from votes", _VECS, _NBR, _VOTES),
    "w3_prefix_distances": _q("select query, n, round(mindist, 6) mindist, round(avgdist, 6) avgdist, round(central_mean, 6) central_mean, round(central_median, 6) central_median from dists", _VECS, _NBR, _VOTES),
    "a3_graph_features": _q("select split_id, query, round(sum(cossim), 6) vote, round(max(cossim), 6) mindist, round(avg(cossim), 6) avgdist, count(*) cnt from nbr join splits on splits.word = nword where part = 'ref' group by all", _VECS, _NBR, _SPLITS),
    "a5_centroid_similarity": _q("select split_id, word, round(csim, 6) + 0.0 csim from csims", _VECS, _SPLITS, _CENTROID),
    "j5_glossary_similarity": _q("select word, gword, round(cossim, 6) + 0.0 cossim from gs", _VECS, _GSIMS),
    "a4_glossary_features": _q("select split_id, word, round(max(cossim), 6) mindist_all, round(avg(cossim), 6) avgdist_all, round(list_sum((list(cossim order by cossim desc))[1:10]), 6) votetopk_all from gs join splits s on s.word = gword where part = 'ref' group by split_id, gs.word", _VECS, _SPLITS, _GSIMS).replace("select split_id, word, round(max", "select split_id, gs.word, round(max"),
    "x11_aggregate_embeddings": _q("select word, cnt, unnest(range(4))::int dim, unnest([round(a / n, 6) for a in x]) x from (select word, cnt, x, sqrt(list_dot_product(x, x)) n from (select word, max(c) cnt, list(m order by d) x from (select token word, d, count(*) c, avg(('0x' || substr(md5(concat_ws('/', token, pos % 3, d)), 1, 6))::bigint::double / 16777216) m from toks, (select unnest(range(4)) d) group by all) group by word))", _TOKENS),
    "s11_corpus_tokens": _q("select id doc_id, pos::int pos, token from toks", _TOKENS),
    "c_curve_summary": _q(f'select "key", {_SUMMARY} from summary', _SCORED, _curves("groups", '"key"')),
    "c5_curve_points": _q('select "key", score, np, nn, tp, fp, pos, neg, round(tpr, 6) tpr, round(fpr, 6) fpr, round("precision", 6) as "precision", round(recall, 6) recall from points', _SCORED, _curves("groups", '"key"')),
    "a8_at_threshold": _q('select "key", tp, fp, fn, tn, round(coalesce(tp::double / nullif(tp + fp, 0), 0), 6) as "precision", round(coalesce(tp::double / nullif(tp + fn, 0), 0), 6) recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6)::double f1 from (select "key", sum(case when score > ba_threshold then np else 0 end)::bigint tp, sum(case when score > ba_threshold then nn else 0 end)::bigint fp, sum(case when score > ba_threshold then 0 else np end)::bigint fn, sum(case when score > ba_threshold then 0 else nn end)::bigint tn from groups join summary using ("key") group by "key")', _SCORED, _curves("groups", '"key"')),
    "c_lineitem_curves": _q(f"select l_suppkey, {_SUMMARY} from summary", "groups as (select l_suppkey, l_extendedprice::double score, count(*) filter (l_returnflag = 'R') np, count(*) filter (l_returnflag <> 'R') nn from lineitem group by l_suppkey, l_extendedprice)", _curves("groups", "l_suppkey")),
    "t_rank_metrics": _q(_RANKS.format(ks="[50, 100, 200, 5000]"), _SCORED, 'ranked as (select *, row_number() over (partition by "key" order by score desc, event_id) rn from scored)'),
    "t10_candidates": _q("from scored order by score desc, event_id limit 50", _SCORED),
    "g6_random_ties": _q(_RANKS.format(ks="[50, 100]"), _SCORED, """ranked as (select *, row_number() over (partition by "key" order by score desc, md5(concat_ws('/', 42, "key", event_id)), event_id) rn from scored)"""),
    "g1_random_splits": _q("from r", _VECS, _splits("r", "select distinct word from raw")),
    "g2_stratified_splits": _q("from r", _VECS, _NBR, _splits("r", "select word, label from labels_ where word not in (from stop)", "label", 2.0)),
    "u3_verify_splits": _q("select split_id, sum(again)::bigint repeated, count(*) filter (parts > 1) shared from (select split_id, word, sum(c - 1) again, count(*) parts from (select split_id, word, part, count(*) c from (from r union all from splits) group by all) group by all) group by split_id", _VECS, _splits("r", "select distinct word from raw"), _SPLITS),
    "a13_part_sizes": _q("select part, min(c) least, max(c) most, round(avg(c), 6) mean from (select split_id, part, count(*) c from r group by all) group by part", _VECS, _NBR, _splits("r", "select word, label from labels_", "label", 2.0)),
    "a14_split_info": _q("select split_id, part, count(*) size, count(label) matched, count(*) filter (label = 1) positive, count(*) filter (label = 0) negative from r left join (from labels_ where word not like '%7') using (word) group by all", _VECS, _NBR, _splits("r", "select distinct word from raw")),
    "p11_pools": _q("from pool", _VECS, _SPLITS, _POOLS.format(words="raw")),
    "g3_pools": _q("from positive union all select split_id, part, word, 0 from (select *, row_number() over (partition by split_id, part order by md5(concat_ws('/', 42, part, split_id, word)), word) rn from pool where label = 0) join (select split_id, part, count(*) c from positive group by all) using (split_id, part) where rn <= floor(c * 3.0)", _VECS, _SPLITS, _POOLS.format(words="raw")),
    "g4_training_sample": _q("select label, word from (select *, row_number() over (partition by label order by md5(concat_ws('/', 42, 'train', label, word)), word) rn from raw where word not in (from glossary)) where rn <= 5", _VECS),
    "g5_randomised": _q("select split_id, part, b.word from splits s join a using (word) join b using (rn)", _VECS, _SPLITS, "a as (select word, row_number() over (order by md5(concat_ws('/', 42, 'terms', word)), word) rn from (select distinct word from splits)), b as (select word, row_number() over (order by md5(concat_ws('/', 42, 'pool', word)), word) rn from (select distinct word from raw where word not in (from stop) and word not in (select word from splits)))"),
    "u1_master_list": _q("select distinct word from splits where word not in (from stop)", _VECS, _SPLITS),
    "u2_master_stop": _q("select distinct word from raw where label < 2 and word in (from glossary)", _VECS),
    "t6_reliable_negatives": _q("select split_id, word, round(csim, 6) csim from (select *, row_number() over (partition by split_id order by csim, word) rn from csims) where rn <= 15", _VECS, _SPLITS, _CENTROID),
    "j3_vocabulary_ids": _q("select word, row_number() over (order by word) - 1 id from (select distinct word from raw)", _VECS),
    "a1_majority_class": r"with t as (select doc_id, unnest([x for x in regexp_split_to_array(lower(trim(coalesce(text, ''), ' ')), '\s+') if x <> '']) word from documents) select word, case when sum(quality) > count(quality) / 2 then 1 else 0 end::int as label from t join labels using (doc_id) group by word",
    "j6_lexical_similarity": _q("select brand, word, round(max(sim), 6) lexical from (select a.word, b.word ref, round(sum(a.w * b.w), 10) sim from wn a join wn b using (ngram) where a.word in (from names) and b.word in (select word from refs) group by all) s join (select brand, word ref from refs) using (ref) group by brand, word", _GRAMS),
    "a9_summary": _q("select metric, n, round(mean, 6) mean, round(std, 6) std, round(median, 6) median, round(least, 6) least, round(most, 6) most, round(mean - 1.96 * std / sqrt(n), 6) ci_low, round(mean + 1.96 * std / sqrt(n), 6) ci_high from (select metric, count(*) n, avg(value) mean, stddev_pop(value) std, quantile_cont(value, 0.5) median, min(value) least, max(value) most from results group by metric)", _RESULTS),
    "a10_bootstrap": _q("select metric, round(quantile_cont(m, 0.025), 6) ci_low, round(quantile_cont(m, 0.975), 6) ci_high from ms group by metric", _RESULTS, _DRAWS),
    "a12_histogram": "with e as (select event_type, min(value) lo, max(value) hi, avg(value) mean from events group by 1), b as (select event_type, lo, hi, mean, case when hi > lo then least(19, floor((value - lo) / (hi - lo) * 20)) else 0 end::int bin, count(*) n from events join e using (event_type) group by all) select event_type, bin, round(lo + bin * ((hi - lo) / 20), 6) low, round(lo + (bin + 1) * ((hi - lo) / 20), 6) high, n, round(mean, 6) mean from b",
    "a7_class_rates": _q("select n, positives, round(positives / n, 6) positive_rate, round(least(positives / n, 1 - positives / n), 6) minority_rate from (select count(*) n, sum(label)::bigint positives from scored)", _SCORED),
    "a20_separation": _q('select "key", round(a, 6) mean_pos, round(b, 6) std_pos, round(c, 6) mean_neg, round(d, 6) std_neg, round(a - c, 6) separation from (select "key", avg(score) filter (label = 1) a, stddev_pop(score) filter (label = 1) b, avg(score) filter (label <> 1) c, stddev_pop(score) filter (label <> 1) d from scored group by 1)', _SCORED),
    "p14_health_flags": "select count(*) n, count(*) filter (event_id % 100 = 0) n_nan, 0::bigint n_inf, string_agg(distinct (user_id < 5)::int::varchar, ',' order by (user_id < 5)::int::varchar) labels, 'nan' || case when least(avg((user_id < 5)::int), 1 - avg((user_id < 5)::int)) < 0.05 then ',imbalanced' else '' end flags from events",
    "a15_global_counts": _q("select vocabulary, queries, queries_with_vector, glossary, glossary_in_queries, glossary_usable, round(glossary_usable / glossary, 6) usable_share from (select count(*) vocabulary, count(*) filter (label <> 9) queries, count(*) filter (label not in (8, 9)) queries_with_vector, count(*) filter (g) glossary, count(*) filter (g and label <> 9) glossary_in_queries, count(*) filter (g and label not in (8, 9)) glossary_usable from (select label, word in (from glossary) g from raw))", _VECS),
    "a16_chance_levels": _q("select split_id, part, k::int k, round(p, 6) prevalence, round(k * p, 6) chance from (select split_id, part, avg(label) p from pool group by all), (select unnest([50, 100, 200]) k)", _VECS, _SPLITS, _POOLS.format(words="raw")),
    "w9_hybrid": _q('select "key", event_id, round((score - avg(score) over w) / stddev_pop(score) over w, 6) + 0.0 hybrid from scored window w as (partition by "key")', _SCORED),
    "f1_log_events": _q("from log_events", _LOG),
    "w6_pair_metrics": _q("from pairs_", _LOG),
    "r1_pair_stream": _q("from pairs_", _LOG),
    "s8_log_files": _q("select run, kind, count(*) n, round(sum(value), 6) total, min(n) as \"first\", max(n) as \"last\" from log_events join (select run, event_id line, row_number() over (partition by run order by event_id) - 1 n from ev) using (run, line) group by all", _LOG),
    "x12_training_log": _q("from log_metrics", _LOG),
    "a17_round_average": _q("select log_label, round, round(avg(-m), 6) loss, count(*) sites from (select log_label, series, round, max(validation_metric) m from log_metrics where series like 'site:%' group by all) group by all", _LOG),
    "w7_best_so_far": _q("select run, r::int round, best from (select run, r, last_value(v ignore nulls) over (partition by run order by r) best from (select run, unnest(range(0, max(round) + 1)) r from log_events group by run) left join (select run, round r, (list(value order by line desc))[1] v from log_events where kind = 'best' group by all) using (run, r)) where best is not null", _LOG),
    "a19_run_overview": _q("select run, b.round last_best_round, b.value last_best, sites from (select run, (list({'round': round, 'value': value} order by line desc) filter (kind = 'best'))[1] b from log_events group by run) join (select run, string_agg(site, ',' order by line, site) sites from (select run, site, min(line) line from log_events where site is not null group by all) group by run) using (run)", _LOG),
    "x13_best_checkpoint": _q("select run, n, first_round, last_round, d best_dev_round, dv best_dev, t best_test_round, tv best_test, final_test, tv < worst * 0.5 converged, 'FL_global_model_' || t || '.pt' target from (select run, count(*) n, min(round) first_round, max(round) last_round, (list(round order by dev_ppl, round))[1] d, min(dev_ppl) dv, (list(round order by test_ppl, round))[1] t, min(test_ppl) tv, (list(test_ppl order by round desc))[1] final_test, max(test_ppl) worst from perf group by run)", _PERF),
    "x14_run_configs": "with e as (select 'run' || (user_id % 4) run, event_id, value, user_id, dayofmonth(ts) d, row_number() over (partition by user_id % 4 order by lpad(event_id::varchar, 12, '0')) rn from events where event_id % 100 <> 0), f as (from e where rn = 1) select run, 'lr' as \"key\", printf('%.3f', value)::decimal(20, 3)::double::varchar as value from f union all select run, 'batch_size', user_id::varchar from f union all select run, 'num_rounds', d::varchar from f",
    "s3_splits_json": _q("select split_id, part, (row_number() over (partition by split_id, part order by word) - 1)::int pos, word from splits", _VECS, _SPLITS),
    "s5_scores_csv": "select 'p' || p_partkey word, 'price' as method, round(p_retailprice::double, 6) score from part union all select 'p' || p_partkey, 'size', p_size::double from part",
    "s6_checkpoint_csv": _q("select run, round, dev_ppl, test_ppl from perf where round % 9 <> 0", _PERF),
    "s10_grid_cell": _q("select query, label, round(vote, 6) score from votes join labels_ on word = query where weight_type = 'inverse' and n = 7", _VECS, _NBR, _VOTES),
    "x1_grid_evaluate": _q("""select weight_type, n, 'ba' threshold_on, round(roc_auc, 6) roc_auc, round(average_precision, 6) average_precision, round(ba_threshold, 6) threshold,
 round(coalesce(tp::double / nullif(tp + fp, 0), 0), 6) as "precision", round(coalesce(tp::double / nullif(tp + fn, 0), 0), 6) recall, round(coalesce(2.0 * tp::double / nullif(2 * tp + fp + fn, 0), 0), 6) f1
 from (select weight_type, n, sum(case when score > ba_threshold then np else 0 end) tp, sum(case when score > ba_threshold then nn else 0 end) fp, sum(case when score > ba_threshold then 0 else np end) fn from groups join summary using (weight_type, n) group by all) join summary using (weight_type, n)
 union all select weight_type, n, 'f1', round(roc_auc, 6), round(average_precision, 6), round(f1_threshold, 6), round(f1_precision, 6), round(f1_recall, 6), round(f1_best, 6) from summary""", _VECS, _NBR, _VOTES, _VOTE_GROUPS, _curves("groups", "weight_type, n")),
    "x2_split_evaluate": _q("from result", _VECS, _NBR, _STRATA, _VOTES, _STRAT_POOL, "scores as (select split_id, weight_type, n, query, round(vote, 10) score from votes, all_splits)", _select_and_test("weight_type, n", "weight_type, n")),
    "x3_list_evaluate_vote": _list("vote"),
    "x3_list_evaluate_mindist": _list("mindist"),
    "x3_list_evaluate_avgdist": _list("avgdist"),
    "x4_approach_evaluate": _q("from result", _VECS, _NBR, _STRATA, _VOTES, _STRAT_POOL, """long as (select 'votes' approach, weight_type, n, query, round(vote, 10) score from votes union all select 'votes_norm', weight_type, n, query, round(vote_norm, 10) from votes
 union all select 'distances', 'mean', n, query, round(exp(-central_mean), 10) from dists union all select 'distances', 'median', n, query, round(exp(-central_median), 10) from dists), scores as (select split_id, long.* from long, all_splits)""", _select_and_test("approach, weight_type, n", "weight_type, n", "f1", "approach")),
    "x7_centroid_evaluate": _q('select split_id, k, pos, neg, round(roc_auc, 6) roc_auc, round(average_precision, 6) average_precision, round("precision", 6) as "precision" from cres', _CENT_RES.format(pools=_POOLS.format(words="(from raw where label <> 5)"), extra="")),
    "x9_diagnose_best": _q("select weight_type, n, round(roc_auc, 6) roc_auc from (select *, row_number() over (partition by weight_type order by roc_auc desc, n) rn from summary where roc_auc is not null) where rn = 1", _VECS, _NBR, _VOTES, _VOTE_GROUPS, _curves("groups", "weight_type, n")),
    "x15_side_by_side": _q("""select metric as method, round(avg(value) filter ("key" % 2 = 0), 6) m0, round(avg(value) filter ("key" % 2 = 1), 6) m1 from results group by metric""", _RESULTS),
    "s4_word_list": r"with n as (select distinct trim(array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(p_name, ' ')], ' ')) w from part) select w word, 'line' as mode from n union all select distinct regexp_split_to_array(w, '\s+')[1], 'token' from n union all select distinct lower(w), 'lower' from n",
    "s7_log_metrics_csv": _q("from log_metrics where round <> 5", _LOG),
    "s9_config_docs": "select 'u' || user_id run, 'batch_size' as \"key\", count(*)::varchar as value from events where user_id % 10 <> 0 group by user_id",
    "s12_restrict_vocabulary": _q("select distinct nword word from nbr", _VECS, _NBR),
    "p13_model_names": _q("select run, string_agg(distinct 's' || length(site), '+' order by 's' || length(site)) model from log_events where site is not null group by run", _LOG),
    "t11_longest_run": _q("select run, count(distinct round) rounds from log_events where round is not null group by run order by rounds desc, run limit 1", _LOG),
    "u4_used_negatives": _q("from used", _VECS, _SPLITS, _CENTROID, _POOLS.format(words="raw"), _USED),
    "x8_split_counts": _q("""select split_id, "ref", dev, test, "ref" ref_usable, test test_pos, u train_neg_used, nb - u ranked_neg, test + nb - u ranked_total, round(p, 6) prevalence, round(50 * p, 6) chance_at_50, round(100 * p, 6) chance_at_100, round(200 * p, 6) chance_at_200
 from (select *, test / (test + nb - u) p from size join (select split_id, count(*) u from used group by split_id) using (split_id), (select count(*) nb from background))""", _VECS, _SPLITS, _CENTROID, _POOLS.format(words="raw"), _USED),
    "x9_diagnose_flags": _q("select count(*) n, 0::bigint n_nan, 0::bigint n_inf, '0,1' labels, case when least(avg(label), 1 - avg(label)) < 0.05 then 'imbalanced' else '' end flags from vs where n = 11", _VECS, _NBR, _VOTES, _VOTE_GROUPS),
    "x5_split_report": _q("select k, metric, n, round(mean, 6) mean, round(std, 6) std, round(median, 6) median, round(least, 6) least, round(most, 6) most, round(ci_low, 6) ci_low, round(ci_high, 6) ci_high from stats join (select k, metric, quantile_cont(m, 0.025) ci_low, quantile_cont(m, 0.975) ci_high from ms group by all) using (k, metric)", _CENT_RES.format(pools=_POOLS.format(words="raw"), extra=""), """res as (unpivot (select k, roc_auc::double roc_auc, average_precision::double average_precision, "precision"::double as "precision" from cres) on roc_auc, average_precision, "precision" into name metric value v),
stats as (select k, metric, count(*) n, avg(v) mean, stddev_samp(v) std, quantile_cont(v, 0.5) median, min(v) least, max(v) most from res group by all),
nb as (select k, metric, v, row_number() over (partition by k, metric order by v) - 1 i, count(*) over (partition by k, metric) n from res),
dr as (select k, metric, n, b, unnest(range(n)) d from (select distinct k, metric, n from nb), (select unnest(range(10000)) b)),
di as (select k, metric, b, ('0x' || substr(md5(concat_ws('/', 42, b, d)), 1, 15))::bigint % n i from dr),
ms as (select k, metric, b, avg(v) m from di join nb using (k, metric, i) group by all)"""),
    "x10_score_words": _q("select word, round(mindist_all, 6) mindist_all, round(avgdist_all, 6) avgdist_all, round(votetopk_all, 6) votetopk_all, round(centroid, 6) centroid, round(log_count, 6) log_count from sw", _VECS, _SW),
    "x10_evaluate_scores": _q("""select method, k::int k, round(roc_auc, 6) roc_auc, round(average_precision, 6) average_precision, round(tp / k, 6) as "precision", round(tp / pos, 6) recall, round((neg - (least(k, pos + neg) - tp)) / neg, 6) specificity, round(case when tp > 0 then 2 * (tp / k) * (tp / pos) / (tp / k + tp / pos) else 0 end, 6) f1
 from summary join (select method, k, sum(case when rn <= k then label else 0 end)::double tp from rk, (select unnest([50, 100, 200]) k) group by method, k) using (method)""", _VECS, _SW, """long as (select s.word, (r.label = 3)::int label, m.method, m.score from sw s join raw r using (word), lateral (select unnest(['centroid', 'log_count', 'avgdist_all']) method, unnest([centroid, log_count, avgdist_all]) score) m),
groups as (select method, score, sum(label)::bigint np, sum(1 - label)::bigint nn from long group by all), rk as (select *, row_number() over (partition by method order by score desc, word) rn from long)""", _curves("groups", "method")),
    "a25_model_sites": _q("""select run, case when k is null then '?' else array_to_string(k, ', ') end sites, case when k is null then 'model_' || run else 'Model ' || array_to_string([chr(65 + x[2:]::int) for x in k], '') end model
 from (select run, list_sort(list(distinct site) filter (site in ('c0', 'c1', 'c2', 'c3', 'c4', 'c5', 'c6', 'c7', 'c8', 'c9', 'c10', 'c11'))) k from (select run, site from log_events where site is not null union all select 'run9', null) group by run)""", _LOG),
    "r2_best_stream": _q("select run, b.round round, b.value best from (select run, (list({'round': round, 'value': value} order by line desc) filter (kind = 'best'))[1] b from log_events group by run) where b is not null", _LOG),
    "r2_round_average_stream": _q("select run, round, round(avg(-value), 6) loss, count(*) n from pairs_ group by all", _LOG),
    "k2_neighbour_store": _q("select query, rank::int rank, nword, round(distance, 6) distance from nbr", _VECS, _NBR),
    "k5_vectors": _q('select word, round(sqrt(list_dot_product(v, v)), 6) as "length", len(v)::int dims from vecs', _VECS),
    "x17_list_to_splits": _q("from r", _VECS, _NBR, _MASTER, _splits("r", "select word, label from master where label is not null", "label", 4.0)),
    "j11_list_counts": _q("select count(*) words, count(label) matched, count(*) - count(label) unmatched, count(*) filter (label = 1) positive from master", _VECS, _NBR, _MASTER),
    "p8_keep_last": "select label::int as label, vec_id as at, 'w' || vec_id word from (select *, row_number() over (partition by label order by vec_id desc) rn from embeddings) where rn = 1",
    "u5_ref_pools": _q("""select split_id, part, label, count(*) n, min(word) as "first" from (select split_id, part, word, 1 label from splits where part <> 'ref' union all
 select c.split_id, c.part, w.word, 0 from (select distinct word from raw where word not in (from stop)) w, (select split_id, unnest(['dev', 'test']) part from (select distinct split_id from splits)) c
 where not exists (select 1 from splits s where s.split_id = c.split_id and s.word = w.word and s.part in ('ref', c.part))) group by split_id, part, label""", _VECS, _SPLITS),
    "a16_enrichment": _q('select k, round(chance, 6) chance, round(observed, 6) observed, round(observed / chance, 6) enrichment from (select k, avg(k * pos / (pos + neg)) chance, avg("precision") * k observed from cres group by k)', _CENT_RES.format(pools=_POOLS.format(words="raw"), extra="")),
    "a23_metric_table": _q("""select 'm' || ("key" % 3) as method, round(avg(value) filter (metric = 'roc_auc'), 6) roc_auc_mean, round(stddev_pop(value) filter (metric = 'roc_auc'), 6) roc_auc_std, round(avg(value) filter (metric = 'average_precision'), 6) average_precision_mean, round(stddev_pop(value) filter (metric = 'average_precision'), 6) average_precision_std from results group by 1""", _RESULTS),
    "m4_fixed_weights": _q('select "key", event_id, round(1 / (1 + exp(-(0.75 + 0.5 * (score - 40) / 12 + case when event_id % 7 = 0 then 0 else -1.25 * (event_id % 10 - 4.5) / 3 end))), 6) p from scored', _SCORED),
    "x6_features": _q(f"select split_id, word, {', '.join(f'round({c}, 6) + 0.0 {c}' for c in _FEATURES)} from feat", _VECS, _NBR, _SPLITS, _CENTROID, _GSIMS, _FEATS),
    "x6_training_rows": _q('select split_id, clf, word, "label" from tr', _VECS, _SPLITS, _CENTROID, _POOLS.format(words="raw"), _TRAIN),
    "m1_fitted_optima": _q('select split_id, clf, count(*) filter ("label" = 1) positives, count(*) filter ("label" = 0) negatives, true optimal from tr group by split_id, clf', _VECS, _SPLITS, _CENTROID, _POOLS.format(words="raw"), _TRAIN),
    "m6_fitted_by_all": _q('select clf, count(*) filter ("label" = 1) positives, count(*) filter ("label" = 0) negatives, true optimal from tr group by clf', _VECS, _SPLITS, _CENTROID, _POOLS.format(words="raw"), _TRAIN),
    "a24_weight_table": _q("select feature, round(avg(x), 6) pu_lr_weight_mean, round(stddev_pop(x), 6) pu_lr_weight_std, round(avg(-0.5 * x), 6) + 0.0 pu_rn_weight_mean, round(stddev_pop(-0.5 * x), 6) pu_rn_weight_std from (select names[i + 1] feature, 0.5::double - 0.125::double * i + 0.0625::double * split_id x from (select distinct split_id from splits), (select unnest(range(9)) i), (select " + str(list(_FEATURES)) + " names)) group by feature", _VECS, _SPLITS),
    "x6_given_classifiers": _q("""select split_id, method, k::int k, round(roc_auc, 6) roc_auc, round(average_precision, 6) average_precision, round(p, 6) as "precision", round(r, 6) recall, round(coalesce((n - pos - (least(k, n) - tp))::double / nullif(n - pos, 0), 0), 6) specificity, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) f1
 from (select *, tp::double / least(k, n) p, coalesce(tp::double / nullif(pos_, 0), 0) r from summary join (select split_id, method, k, count(*) n, sum(y) pos_, sum(case when rn <= k then y else 0 end) tp from rk, (select unnest([50, 100, 200]) k) group by all) using (split_id, method))""", _VECS, _NBR, _SPLITS, _CENTROID, _GSIMS, _POOLS.format(words="raw"), _FEATS, _TRAIN, _GIVEN, _curves("groups", "split_id, method")),
    "x13_checkpoint_report": _q("""select run, sites, case when sites is null then 0 else len(string_split(sites, ',')) end::int n_sites, num_rounds, min_clients, last_best_round, round(last_best, 6) last_best, round(-last_best, 6) validation_loss, n, first_round, last_round, d best_dev_round, dv best_dev, t best_test_round, tv best_test, final_test, tv < worst * 0.5 converged, t < last_round * 0.5 early,
 'FL_global_model_' || coalesce(t, last_best_round) || '.pt' target, coalesce(nf, 0) n_found, coalesce(list_contains(fs, coalesce(t, last_best_round)), false) on_disk from ov full join st using (run) full join pf using (run) left join fd using (run)""", _LOG, _PERF, """ov as (select run, b.round last_best_round, b.value last_best, sites from (select run, (list({'round': round, 'value': value} order by line desc) filter (kind = 'best'))[1] b from log_events group by run) full join (select run, string_agg(site, ',' order by line, site) sites from (select run, site, min(line) line from log_events where site is not null group by all) group by run) using (run)),
st as (select 'run' || (user_id % 4) run, (list(event_id::varchar order by event_id % 3 = 0, event_id))[1] num_rounds, (list(user_id::varchar order by event_id % 3 = 0, event_id))[1] min_clients from events group by 1),
pf as (select run, count(*) n, min(round) first_round, max(round) last_round, (list(round order by dev_ppl, round))[1] d, min(dev_ppl) dv, (list(round order by test_ppl, round))[1] t, min(test_ppl) tv, (list(test_ppl order by round desc))[1] final_test, max(test_ppl) worst from perf where run <> 'run2' group by run),
fd as (select run, count(*) nf, list(round) fs from perf where run <> 'run1' and round % 2 = 0 group by run)"""),
    "k4_config_table": _q(f"""select case when k is null then 'model_' || s.run else 'Model ' || array_to_string([chr(65 + x[2:]::int) for x in k], '') end model_name, (row_number() over (order by s.run))::int model_num, case when k is null then '?' else array_to_string(k, ', ') end sites,
 {', '.join({'num_rounds': "coalesce(d::varchar, '') num_rounds", 'lr': "coalesce(printf('%.3f', value)::decimal(20, 3)::double::varchar, '') lr", 'batch_size': "coalesce(user_id::varchar, '') batch_size"}.get(k, f"'' {k}") for k in ALIASES)}
 from (select run, list_sort(list(distinct site) filter (site in ('c0', 'c1', 'c2', 'c3', 'c4', 'c5', 'c6', 'c7', 'c8', 'c9', 'c10', 'c11'))) k from log_events where site is not null group by run) s
 left join (from (select 'run' || (user_id % 4) run, value, user_id, dayofmonth(ts) d, row_number() over (partition by user_id % 4 order by lpad(event_id::varchar, 12, '0')) rn from events where event_id % 100 <> 0) where rn = 1) f using (run)""", _LOG),
    "x5_report_tables": _q("""select 'aggregated' part, metric || '_' || s as "name", round(v, 6) + 0.0 as "value" from (select metric, unnest(['mean', 'std', 'median', 'min', 'max', 'ci95_lo', 'ci95_hi']) s, unnest([mean, std, median, least, most, ci_low, ci_high]) v from stats join (select metric, quantile_cont(m, 0.025) ci_low, quantile_cont(m, 0.975) ci_high from ms group by all) using (metric))
 union all select 'distribution', metric || '/' || bin, count(*)::double from (select metric, case when hi > lo then least(19, floor((v - lo) / (hi - lo) * 20)) else 0 end::int bin from res join (select metric, min(v) lo, max(v) hi from res group by metric) using (metric)) group by metric, bin
 union all select 'test', measure || '_' || s, round(v, 6) from (select measure, unnest(['least', 'most', 'mean', 'median']) s, unnest([min(x), max(x), avg(x), quantile_cont(x, 0.5)]) v from (select unnest(['test_matched', 'test_positive', 'test_negative', 'test_positive_rate']) measure, unnest([m, p, n, coalesce(p / nullif(m, 0), 0)])::double x from info) group by measure)
 union all select 'per_split', 'rows', (select count(*) from cres where k = 50)::double union all select 'split_info', 'size', (select count(*) from r)::double""", _CENT_RES.format(pools=_POOLS.format(words="raw"), extra=""), _NBR, _splits("r", "select distinct word from raw"), """info as (select split_id, count(label) m, count(*) filter (label = 1) p, count(*) filter (label = 0) n from r left join (from labels_ where word not like '%7') using (word) where part = 'test' group by split_id),
res as (unpivot (select roc_auc::double roc_auc, average_precision::double average_precision, "precision"::double as "precision" from cres where k = 50) on roc_auc, average_precision, "precision" into name metric value v),
stats as (select metric, count(*) n, avg(v) mean, stddev_samp(v) std, quantile_cont(v, 0.5) median, min(v) least, max(v) most from res group by all),
nb as (select metric, v, row_number() over (partition by metric order by v) - 1 i, count(*) over (partition by metric) n from res),
dr as (select metric, n, b, unnest(range(n)) d from (select distinct metric, n from nb), (select unnest(range(10000)) b)),
di as (select metric, b, ('0x' || substr(md5(concat_ws('/', 42, b, d)), 1, 15))::bigint % n i from dr),
ms as (select metric, b, avg(v) m from di join nb using (metric, i) group by all)"""),
}
