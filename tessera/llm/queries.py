"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, decontam, licences, neardup, quality, runtime, secrets, tokencount, toxicity, urlfilter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=["doc_id"], lines_col="lines")
    return scored.select(*quality.verdict(scored), "lines")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokencount.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return tokencount.count(_read(spark, sf_dir, "documents").select("doc_id", "text"), pieces, keep=["doc_id"])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.annotate(docs, _read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.array_sort(F.transform("matches", lambda m: m["item_id"].cast("string")))
    longest = F.array_sort(F.transform("matches", lambda m: F.struct(m["item_id"].cast("string").alias("i"), F.concat_ws(":", *(m[k].cast("string") for k in ("item_id", "item_start", "doc_start", "length"))).alias("m"))))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("matches").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.array_join(F.transform(longest, lambda x: x["m"]), ",").alias("matches"),
    )


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(_read(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(secrets.labelled_samples(docs)))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = secrets.listed(F.filter("spans", lambda s: s["kind"] < 3))
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


#: The rules of the contract, and the method's own for URLs that none of these fits.
OP6_RULES = (
    urlfilter.host_rule("allow", "org/"),
    urlfilter.host_rule("block", "example.org/es/"),
    urlfilter.host_rule("block", "example.org/en/1"),
    urlfilter.host_rule("allow", "com/fr/"),
    urlfilter.host_rule("block", "com/de/"),
    *urlfilter.PATTERNS,
)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.classify(_read(spark, sf_dir, "pages").select("page_id", "url"), OP6_RULES, keep=["page_id"])


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in windows of words, across line ends and inside lines."""
    out = licences.notices(_read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.select(
        "doc_id",
        F.size("notices").cast("long").alias("n_licences"),
        F.col("notice").alias("licence"),
        F.array_join(F.transform("notices", lambda h: F.concat_ws(":", h["licence"], h["word"].cast("string"), h["words"].cast("string"), h["dice"].cast("string"))), ",").alias("licences"),
    )


def op8_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no recordings: each vector of `embeddings` is played as a melody. Queries are the rows
    whose id is divisible by 20, against all rows."""
    prints = audio.fingerprints(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", audio.render, keep=["vec_id"])
    prints = runtime.Scratch(spark, "prints").table(prints, "prints")
    return audio.search(prints, "vec_id", F.col("vec_id") % 20 == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"], spans_col="found")
    offending = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select(*toxicity.verdict(scored), offending.alias("spans"))


RANKS = "byte_bpe_multi_50k.tiktoken"


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded_col="decoded", keep=["doc_id"])
    return out.select("doc_id", *bpe.digests(out))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_token_counts, op3_decontamination, op4_near_duplicates, op5_secrets, op6_url_filter, op7_licences, op8_audio_fingerprints, op9_toxicity, op10_bpe)}


#: Words of a text, windows of an item and their occurrences, by joining on the window's words.
OP3_SQL = r"""
with dw as (
  select doc_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> ''), []) as w
  from documents),
iw as (
  select item_id, row_number() over () as ir, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w
  from benchmark),
win as (
  select item_id, ir, i - 1 as ip, least(len(w), 10) as k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') as s
  from (select item_id, ir, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from iw where len(w) > 0)),
ks as (select distinct k from win),
dwin as (
  select doc_id, p, k, array_to_string(list_slice(w, p, p + k - 1), ' ') as s
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from dw, ks where len(w) >= k)),
hit as (select doc_id, item_id, ir, ip, p, dwin.k from dwin join win on dwin.s = win.s and dwin.k = win.k),
pos as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + k)) as q from (select distinct doc_id, p, k from hit)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as l from (select distinct doc_id, cast(item_id as varchar) as i from hit) group by doc_id),
diagonal as (select *, p - 1 - ip as d, ip - row_number() over (partition by doc_id, ir, p - 1 - ip order by ip) as run from hit),
match as (
  select * from (select doc_id, item_id, min(ip) as ip, min(p) - 1 as dp, count(*) + any_value(k) - 1 as n from diagonal group by doc_id, item_id, ir, d, run)
  qualify row_number() over (partition by doc_id, item_id order by n desc, ip, dp) = 1),
matches as (select doc_id, string_agg(item_id || ':' || ip || ':' || dp || ':' || n, ',' order by cast(item_id as varchar)) as m from match group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
  coalesce(m, '') as matches
from dw left join pos using (doc_id) left join items using (doc_id) left join matches using (doc_id)
"""


#: Shared shingles of all pairs, then reachability.
OP4_SQL = r"""
with recursive w as (
  select doc_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) as w
  from documents),
s as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 2), ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
e as (
  select a.doc_id as a, b.doc_id as b
  from s a join s b on a.s = b.s and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n
  having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r(doc_id, c) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on r.c = e.a)
select r.doc_id, cast(coalesce(max(n.n), 0) as bigint) as n_shingles, min(c) as component_id, r.doc_id = min(c) as kept
from r left join n on n.doc_id = r.doc_id group by r.doc_id
"""


_PATTERN_ROWS = ", ".join(f"({i}, '{r.action}', '{r.regex}', {r.weight})" for i, r in enumerate(OP6_RULES) if r.tier == 1)
_HOST_ROWS = ", ".join(
    f"({i}, '{r.action}', '{r.name}', '{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}')" for i, r in enumerate(OP6_RULES) if r.tier == 0
)
OP6_SQL = rf"""
with u as (
  select page_id, row_number() over () as k, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as t from pages),
p as (
  select page_id, k, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(t, length(regexp_extract(t, '^[^/?#]*')) + 1), '^[^?#]*') as path,
    translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(t, length(regexp_extract(t, '^[^/?#]*')) + 1) as text
  from (select page_id, k, coalesce(t, '') as t from u)),
h as (
  select k, action, name from p, (values {_HOST_ROWS}) r(i, action, name, rhost, rpath)
  where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  qualify row_number() over (partition by k order by length(name) desc, i) = 1),
m as (
  select k, action from p, (values {_PATTERN_ROWS}) r(i, action, regex, weight)
  where text <> '' and regexp_matches(text, regex)
  qualify row_number() over (partition by k order by weight desc, i) = 1)
select page_id, host, path, h.name as rule, coalesce(h.action, m.action, 'allow') as verdict
from p left join h using (k) left join m using (k)
"""

_TEMPLATE_ROWS = ", ".join("('%s', '%s', %d)" % (k, g, len(licences.bigrams_of(v))) for k, v in sorted((licences.TEMPLATES | licences.TEXTS).items()) for g in licences.bigrams_of(v))
#: Every window that begins with a bigram of a template, by running sums.
OP7_SQL = rf"""
with t(licence, x, n) as (values {_TEMPLATE_ROWS}),
w as (
  select doc_id, row_number() over () as k, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') as w
  from documents),
g as (select k, unnest(range(1, len(w))) as i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as x from w where len(w) > 1),
b as (select k, i, x, coalesce(lag(i) over (partition by k, x order by i), 0) as before from g),
c as (select b.k, t.licence, t.n from b join t using (x) group by all having count(distinct b.x) * 120 >= t.n * 80),
s as (select c.k, c.licence, c.n, b.i as start from c join t using (licence) join b on b.k = c.k and b.x = t.x),
m as (
  select s.k, s.licence, s.n, s.start, b.i, sum(case when b.before < s.start then 1 else 0 end) over u as all_, sum(case when b.before < s.start and t.x is not null then 1 else 0 end) over u as own
  from s join b on b.k = s.k and b.i between s.start and s.start + s.n * 120 // 80 - 1 left join t on t.licence = s.licence and t.x = b.x
  window u as (partition by s.k, s.licence, s.start order by b.i)),
d as (
  select k, licence, start, i - start + 2 as words, cast(own * 2000 // (all_ + n) as bigint) as dice from m where own * 200 >= (all_ + n) * 80
  qualify row_number() over (partition by k, licence order by own * 2000 // (all_ + n) desc, start, i) = 1),
a as (
  select k, count(*) as n, string_agg(licence || ':' || start || ':' || words || ':' || dice, ',' order by licence) as l, arg_min(licence, (-dice, -words, licence)) as best
  from d group by k)
select doc_id, coalesce(n, 0) as n_licences, best as licence, coalesce(l, '') as licences
from w left join a using (k)
"""


def oracle_sql() -> dict:
    return {"op6_url_filter": OP6_SQL, "op7_licences": OP7_SQL, "op3_decontamination": OP3_SQL, "op4_near_duplicates": OP4_SQL}
