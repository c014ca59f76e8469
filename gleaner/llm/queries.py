"""The queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html, langid, mixing, quality, secrets, sharding, simhash, toxicity, warc
from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=8)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source to the same share, whole documents in the global order."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_html": op2_html,
        "op3_simhash": op3_simhash,
        "op4_sharding": op4_sharding,
        "op5_langid": op5_langid,
        "op6_decontaminate": op6_decontaminate,
        "op7_toxicity": op7_toxicity,
        "op8_quality": op8_quality,
        "op9_mixing": op9_mixing,
        "op10_secrets": op10_secrets,
    }


WARC = """
with p as (
  select page_id, coalesce(html, '') as html from pages
), d as (
  select page_id, strlen(html) as payload_bytes, sha1(html) as payload_digest from p
), f as (
  select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end as first from d
)
select page_id, payload_bytes, payload_digest,
       case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
       case when page_id is distinct from first then first end as refers_to
from f
"""

#: Mixing: the rate of each source, and per rate the distribution function,
#: whose values not above a row's number count its copies. The rates of these
#: tables stay under 8, so that one part draws each.
MIXING = """
with d as (
  select *, coalesce(cast(doc_id as varchar), 'text:' || md5(coalesce(text, ''))) as key from documents
), s as (
  select source, count(*) as n from d group by source
), r as (
  select source, (1.0::double / (select count(*) from s)) * (select sum(n) from s)::double / n as rate from s
), c as (
  select source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1.0::double))) over (partition by source order by k) as upto
  from r, range(0, 80) as t(k)
), l as (
  select source, rate, list(upto order by k) as upto from c group by source, rate
), u as (
  select d.*, l.rate, l.upto,
         (('0x' || substr(md5('42|1|' || d.key), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from d join l on d.source is not distinct from l.source
), n as (
  select *, len(list_filter(upto, lambda x: x <= u)) as n_copies from u
)
select doc_id, text, lang, source, n_chars, rate as mix_rate, cast(n_copies as int) as n_copies, cast(i as int) as copy,
       md5('42-order|' || i || '|' || key) as order_key
from (select *, unnest(range(0, n_copies)) as i from n where n_copies > 0)
"""

QUALITY = r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents
), w as (
  select rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, string_split(text, chr(10)) as lines from d
), p as (
  select rid, unnest(range(1, len(words) - 6)) as pos, words from w
), g as (
  select rid, pos, count(*) over (partition by rid, array_to_string(words[pos:pos+7], ' ')) as n from p
), covered as (
  select rid, count(distinct pos + i) as n_repeat_words from g, range(0, 8) as t(i) where n > 1 group by rid
), l as (
  select rid, sum(n - 1)::bigint as n_dup_lines, sum(n)::bigint as n_lines from (
    select rid, line, count(*) as n from (select rid, unnest(lines) as line from w)
    where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid, line
  ) group by rid
), b as (
  select w.doc_id, w.words, w.lines, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_lines, 0) as n_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from w left join covered using (rid) left join l using (rid)
), f as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
         len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) as n_letter_words,
         list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as full_lines
  from b
), r as (
  select *, case when base_failed then 'base'
    when 10 * n_symbols > 3 * n_words then 'symbols'
    when not (word_chars between 2 * n_words and 15 * n_words) then 'word_length'
    when n_dup_lines > 2 and 100 * n_dup_lines > 30 * n_lines then 'dup_lines'
    when 10 * len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) > 3 * n_words then 'word_runs'
    when 10 * n_letter_words < 7 * n_words then 'few_letters'
    when 10 * len(list_filter(full_lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 3 * n_lines
      or 10 * len(list_filter(full_lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*(•|- |\* )'))) > 9 * n_lines then 'odd_lines'
  end as rejected_by
  from f
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by is null as kept from r
"""


def _either_case(words: str) -> str:
    """ASCII letters in either case, whatever else the engine folds."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in words)


def _secrets_sql() -> str:
    """Places follow from the text between matches; entropies from the characters of each window."""
    assign = _either_case("password|passwd|secret|token|api_?key")
    kinds = [
        (0, "assign", f"""({assign})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", f"length(regexp_extract(hit, '^({assign})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$', 2)) >= 8"),
        (1, "access", "AKIA[A-Z0-9]+", "length(hit) >= 16"),
        (2, "hex", "[0-9a-f]+", "length(hit) >= 32"),
    ]
    for n, c in enumerate(secrets.CLASSES):
        tests = [f"regexp_matches(hit, '{m}')" for m in c.must] + [f"not regexp_matches(hit, '{a}')" for a in secrets.ALLOWED]
        kinds.append((3 + n, c.kind, f"{c.alphabet}{{{secrets.WINDOW},}}", " and ".join(tests)))

    def placed(rank: int, pattern: str, test: str) -> str:
        return f"""select rid, {rank} as rank, hit, upto - length(hit) as start, upto as stop from (
  select rid, hit, sum(length(gap) + length(hit)) over (partition by rid order by pos) as upto from (
    select rid, unnest(string_split_regex(text, '{pattern}')) as gap, unnest(regexp_extract_all(text, '{pattern}')) as hit,
           generate_subscripts(string_split_regex(text, '{pattern}'), 1) as pos from d) where hit is not null) where {test}"""

    w = secrets.WINDOW
    least = ", ".join(f"({3 + n}, {c.threshold})" for n, c in enumerate(secrets.CLASSES))
    names = "['" + "', '".join(secrets.KINDS) + "']"
    text = f"(({names})[rank + 1] || ':' || start || ':' || stop)"
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
base as ({" union all ".join(placed(r, p, t) for r, _, p, t in kinds[:3])}),
cand as (select row_number() over () as cid, * from ({" union all ".join(placed(r, p, t) for r, _, p, t in kinds[3:])})),
win as (select cid, i, unnest(string_split(substr(hit, i, {w}), '')) as c from (select cid, hit, unnest(range(1, length(hit) - {w - 2})) as i from cand)),
ent as (select cid, i, log2({w}) - sum(n * log2(n)) / {w}.0::double as bits from (select cid, i, c, count(*) as n from win group by all) group by all),
good as (select cand.cid, i, case when i - lag(i) over (partition by cand.cid order by i) <= {w} then 0 else 1 end as new
  from ent join cand using (cid) join (values {least}) as t(rank, least) using (rank) where bits >= least - 1e-9),
runs as (select cid, min(i) as a, max(i) as b from (select cid, i, sum(new) over (partition by cid order by i) as run from good) group by cid, run),
more as (select rid, rank, start + a - 1 as start, start + b - 1 + {w} as stop from runs join cand using (cid)),
apart as (select * from more m where not exists (select 1 from base b where b.rid = m.rid and b.start < m.stop and m.start < b.stop)),
every as (select rid, rank, start, stop, true as own from base union all select *, false from apart)
select doc_id, count(*) filter (own and rank = 0) as n_assign, count(*) filter (own and rank = 1) as n_access, count(*) filter (own and rank = 2) as n_hex,
  sha256(coalesce(string_agg({text}, ',' order by start, rank, stop) filter (own), '')) as base_sha256, coalesce(string_agg({text}, ',' order by start, rank, stop), '') as spans
from d left join every using (rid) group by rid, doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": WARC, "op8_quality": QUALITY, "op9_mixing": MIXING, "op10_secrets": _secrets_sql()}
