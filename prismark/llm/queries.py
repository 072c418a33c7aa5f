"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismark.llm import decontamination, language_id, licences, line_dedup, near_duplicates, nearest_neighbours, packing, quality, spelling, token_counts, url_filter, warc, whitening
from prismark.llm.common import materialise, scratch, table, tuned
from prismark.llm.tokenizing import public_path

TOKENIZER = "byte_bpe_50k.json"

# The rules that the filter is asked to apply, and the words that put a host on the example list.
URL_RULES = [
    url_filter.Rule("org/", "allow"),
    url_filter.Rule("example.org/es/", "block"),
    url_filter.Rule("example.org/en/1", "block"),
    url_filter.Rule("com/fr/", "allow"),
    url_filter.Rule("com/de/", "block"),
]
LISTED_HOSTS = "(^|[.-])(ads|adult|bets|casino|pills|porn|spam)([.-]|$)"


def host_list(pages: DataFrame) -> DataFrame:
    """The list of hosts to block, as a table. The given tables have none, so it is drawn from their hosts by word; any other table with a column host does."""
    return pages.select(url_filter.host_of(F.col("url")).alias("host")).where(F.col("host").rlike(LISTED_HOSTS)).distinct()


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, URL_RULES, materialise(host_list(pages), "host-list")).drop("listed")


OP1_SQL = f"""
with a as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
b as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, regexp_extract(rest, '^[^?#]*') as upto from a),
c as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, substr(upto, length(raw) + 1) as path from b),
d as (select *, case
    when ('.' || host) like '%.example.org' and starts_with(path, '/en/1') then 'example.org/en/1'
    when ('.' || host) like '%.example.org' and starts_with(path, '/es/') then 'example.org/es/'
    when ('.' || host) like '%.com' and starts_with(path, '/fr/') then 'com/fr/'
    when ('.' || host) like '%.com' and starts_with(path, '/de/') then 'com/de/'
    when ('.' || host) like '%.org' and starts_with(path, '/') then 'org/' end as rule from c)
select page_id, host, path, rule, case
    when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
    when regexp_matches(host, '{LISTED_HOSTS}') then 'block' else 'allow' end as verdict
from d
"""


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(tuned(spark), sf_dir, "embeddings")
    return nearest_neighbours.search(vectors, F.col("vec_id") % 50 == 0)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP3_SQL = f"""
with dw as (select doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
bw as (select item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
items as (select distinct item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as s
    from (select item_id, w, least(10, len(w)) as n from bw where len(w) > 0)),
spans as (select distinct n from items),
starts as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from dw, spans where len(w) >= n),
met as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as s from starts),
hits as (select doc_id, i, n, s from met where s in (select s from items)),
words as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hits) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as names
    from (select distinct doc_id, item_id from hits join items using (s)) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words using (doc_id) left join named using (doc_id)
"""


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(tuned(spark), sf_dir, "documents"), public_path(TOKENIZER))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), evidence=page_metadata(table(spark, sf_dir, "pages")), few_rows=quality.FEW_ROWS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(tuned(spark), "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = materialise(warc.read_archives(spark, path, payloads=False).drop("payload"), "records")
    return warc.resolve_read(records)


OP6_SQL = """
with a as (select page_id, coalesce(html, '') as payload from pages),
b as (select page_id, octet_length(encode(payload)) as payload_bytes, sha1(payload) as hex from a),
c as (select *, list_transform(range(8), lambda i: ('0x' || substr(hex, 1 + 5 * i, 5))::bigint) as v from b),
d as (select page_id, payload_bytes, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31) + 1, 1)), '')), '') as payload_digest from c),
e as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
    case when page_id != first then first end as refers_to
from e
"""


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(tuned(spark), sf_dir, "documents"), percent=85)


OP7_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 85 * (na.n + nb.n - k)),
ways as (select a, b from links union all select b, a from links),
reached(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, ways.b from reached r join ways on ways.a = r.other),
lowest as (select doc_id, min(other) as component_id from reached group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from lowest left join n using (doc_id)
"""


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def _op8_sql() -> str:
    """Sentences on lines of their own, as the tables have them; rules are tried in order on what is left."""
    known = ", ".join(f"('{name}', '{sentence}')" for sentence, name in licences.KNOWN.items())
    rules = ", ".join(f"({i}, '{r.licence}', {r.restricts}, '{licences.run_of(r.sentences)}')" for i, r in enumerate(licences.RULES))
    return f"""
with recursive known(name, sentence) as (values {known}), rules(k, licence, restricts, run) as (values {rules}),
cut as (select doc_id, unnest(l) as s, generate_subscripts(l, 1) as i
    from (select doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\r]+', '\\1\n', 'g'), chr(10)) as l from documents)),
norm as (select doc_id, i, trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) as sentence from cut),
found as (select doc_id, string_agg(name, ',' order by i) as sentences, string_agg(',' || name || ',', '' order by i) as line, count(*) as n_sentences from norm join known using (sentence) group by doc_id),
tried(doc_id, k, line, licences, level) as (
    select doc_id, 0, line, []::varchar[], -1 from found
    union all
    select doc_id, t.k + 1, replace(line, run, ',#,'), case when contains(line, run) then list_append(licences, licence) else licences end, case when contains(line, run) then greatest(level, restricts) else level end
    from tried t join rules r on r.k = t.k),
named as (select doc_id, array_to_string(list_sort(list_distinct(licences)), ',') as licences, level from tried where k = {len(licences.RULES)})
select doc_id, coalesce(sentences, '') as sentences, coalesce(licences, '') as licences,
    case level when 0 then 'permissive' when 1 then 'copyleft' when 2 then 'non-commercial' when 3 then 'proprietary' else 'none' end as licence_class,
    coalesce(n_sentences, 0) as n_sentences
from documents left join found using (doc_id) left join named using (doc_id)
"""


#: Languages of the corpus; a row of another one is recognised as none of them only by its low likelihood.
LANGUAGES = ["de", "en", "es", "fr"]


def _of_documents(pages: DataFrame, *said: str) -> DataFrame:
    """doc_id and said of documents whose number ends a page's path, as the tables' pages show documents; of several pages each field is that of the page with the smallest id that has it."""
    number = F.regexp_extract("url", r"://[^/?#]*/(?:[^?#]*/)?([0-9]{1,18})(?:[./?#]|$)", 1)
    pages = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id"), *said).where("doc_id is not null")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col("page_id").isNull(), "page_id", c)))[c].alias(c)
    return pages.groupBy("doc_id").agg(*map(first, said))


def page_evidence(pages: DataFrame) -> DataFrame:
    """(doc_id, declared, address_language, host) of documents that pages show."""
    return _of_documents(pages.select("page_id", "url", *_page_names()), "declared", "address_language", "host")


def _page_names() -> list[Column]:
    url = F.col("url")
    return [language_id.markup_language(F.col("html")).alias("declared"), language_id.address_language(url, LANGUAGES).alias("address_language"), language_id.page_host(url).alias("host")]


def page_metadata(pages: DataFrame) -> DataFrame:
    """page_evidence, and the tags, links and scripts in the page's markup."""
    times = lambda x, name: ((F.length("html") - F.length(F.replace("html", F.lit(x)))) / len(x)).alias(name)
    seen = pages.select("page_id", "url", *_page_names(), times("<", "tags"), times("<a ", "links"), times("<script", "scripts"))
    return _of_documents(seen, "declared", "address_language", "host", "tags", "links", "scripts")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The languages of documents: `lang` is declared, `source` the host, unless a page that shows the document says otherwise."""
    rows = docs.select("doc_id", *keep, "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("address_language"), F.col("source").alias("host"))
    return language_id.identify(rows, LANGUAGES, evidence=page_evidence(table(spark, sf_dir, "pages")), keep=keep)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark, table(tuned(spark), sf_dir, "documents"), sf_dir)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(tuned(spark), sf_dir, "documents"), public_path(TOKENIZER))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(tuned(spark), sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(tuned(spark), sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(tuned(spark), sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP13_SQL = """
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
k as (select *, translate(trim(line, concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
s as (select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
j as (select doc_id, i, line, keeper is not null and keeper != doc_id as gone from k left join s using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from j group by doc_id
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_nearest_neighbours,
        op3_decontamination,
        op4_best_fit_packing,
        op5_quality_classifier,
        op6_warc,
        op7_near_duplicates,
        op8_licences,
        op9_language_id,
        op10_token_counts,
        op11_spelling_variants,
        op12_embedding_whitening,
        op13_line_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {"op1_url_filter": OP1_SQL, "op3_decontamination": OP3_SQL, "op6_warc": OP6_SQL, "op7_near_duplicates": OP7_SQL, "op8_licences": _op8_sql(), "op13_line_dedup": OP13_SQL}
