"""Text functions, page filters and page-level cleaning."""

from pyspark.sql import functions as F

from clauseweave.functions import text as T
from clauseweave.operators import fuzzy, pages as P
from clauseweave.plans.registry import CORE
from clauseweave.plans.session import table


def q(name, sql=None):
    return CORE.add(name, sql)


DUCK_FOREIGN = r"[\p{Han}\p{Hangul}\p{Hiragana}\p{Katakana}\p{Armenian}\p{Arabic}\p{Cyrillic}\p{Greek}\x{C0}-\x{D6}\x{D8}-\x{E8}\x{EA}-\x{F6}\x{F8}-\x{24F}]"
HOST = "regexp_extract(lower(trim(homepage_url)), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]+)', 1)"


@q("detect_english_chars", f"SELECT doc_id, NOT regexp_matches(text, '{DUCK_FOREIGN}') AS english FROM documents WHERE text IS NOT NULL")
def detect_english_chars(spark, folder):
    """TXT-01."""
    return table(spark, folder, "documents").where("text is not null").select("doc_id", T.looks_english(F.col("text")).alias("english"))


@q("ascii_fold", f"SELECT entity_id, translate(name, '{T.ACCENTED}', '{T.PLAIN}') AS folded FROM entity_info")
def ascii_fold(spark, folder):
    """TXT-02."""
    return table(spark, folder, "entity_info").select("entity_id", T.fold_ascii(F.col("name")).alias("folded"))


@q("tokenizer_fixups", r"""SELECT seg_uid, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\be-mails?\b', 'email', 'g'), '(?i)\bwi-fi\b', 'WiFi', 'g'), '(?i)\bgeo-location\b', 'geolocation', 'g'), '\bid\b', 'ID', 'g'), '\b(\w+)\(s\)', '\1s', 'g') AS fixed FROM segments WHERE text IS NOT NULL AND regexp_full_match(text, '[ -~]*')""")
def tokenizer_fixups(spark, folder):
    """TXT-03."""
    return table(spark, folder, "segments").where(F.col("text").rlike(r"^[ -~]*$")).select("seg_uid", T.tokenizer_fixups(F.col("text")).alias("fixed"))


@q("tokenizer_fixups_all", rf"""SELECT seg_uid, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, '{T.ACCENTED}', '{T.PLAIN}'), '(?i)\be-mails?\b', 'email', 'g'), '(?i)\bwi-fi\b', 'WiFi', 'g'), '(?i)\bgeo-location\b', 'geolocation', 'g'), '\bid\b', 'ID', 'g'), '\b(\w+)\(s\)', '\1s', 'g') AS fixed FROM segments WHERE text IS NOT NULL""")
def tokenizer_fixups_all(spark, folder):
    """TXT-02, TXT-03: the texts of all segments, accents folded first; ``tokenizer_fixups`` keeps to plain ASCII."""
    return table(spark, folder, "segments").where("text is not null").select("seg_uid", T.tokenizer_fixups(T.fold_ascii(F.col("text"))).alias("fixed"))


@q("token_text", "SELECT seg_uid, array_to_string(list_transform(list_zip(tokens, spaces), lambda x: x[1] || CASE WHEN x[2] THEN ' ' ELSE '' END), '') AS rebuilt FROM segments")
def token_text(spark, folder):
    """TXT-05, D4."""
    return table(spark, folder, "segments").select("seg_uid", T.rebuild_text(F.col("tokens"), F.col("spaces")).alias("rebuilt"))


@q("bracket_predicates", "SELECT seg_uid, len(list_filter(tokens, lambda t: t IN ('(', '[', '{'))) AS opening, len(list_filter(tokens, lambda t: t IN (')', ']', '}'))) AS closing, len(list_filter(tokens, lambda t: t = '(')) = len(list_filter(tokens, lambda t: t = ')')) AS balanced FROM segments")
def bracket_predicates(spark, folder):
    """TXT-06."""
    n = lambda *s: F.size(F.filter("tokens", lambda t: t.isin(*s))).cast("bigint")
    return table(spark, folder, "segments").select("seg_uid", n("(", "[", "{").alias("opening"), n(")", "]", "}").alias("closing"), (n("(") == n(")")).alias("balanced"))


@q("punct_strip", r"""SELECT seg_uid, array_to_string(list_transform(tokens, lambda t: lower(regexp_replace(t, '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g'))), ' ') AS stripped FROM segments""")
def punct_strip(spark, folder):
    """TXT-07."""
    return table(spark, folder, "segments").select("seg_uid", F.array_join(F.transform("tokens", T.strip_punctuation), " ").alias("stripped"))


@q("reverse_package", "SELECT DISTINCT site, array_to_string(list_reverse(string_split(site, '.')), '.') AS package FROM documents WHERE site IS NOT NULL")
def reverse_package(spark, folder):
    """TXT-10."""
    return table(spark, folder, "documents").where("site is not null").select("site", T.reverse_dotted(F.col("site")).alias("package")).distinct()


SUFFIX_SQL = "'" + "','".join(T.SUFFIXES) + "'"
REG = "CASE WHEN len(l) < 2 THEN host WHEN array_to_string(l[-2:], '.') IN (" + SUFFIX_SQL + ") AND len(l) > 2 THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END"


@q("registered_domain", f"SELECT permalink, host, {REG} AS domain FROM (SELECT DISTINCT permalink, host, string_split(host, '.') AS l FROM (SELECT permalink, {HOST} AS host FROM companies WHERE homepage_url IS NOT NULL))")
def registered_domain(spark, folder):
    """TXT-11, TXT-13."""
    c = table(spark, folder, "companies").where("homepage_url is not null").select("permalink", T.host_of_url(F.col("homepage_url")).alias("host"))
    return c.distinct().withColumn("domain", T.registered_domain(F.col("host")))


@q("ip_literals", f"SELECT l_orderkey, l_linenumber, l_partkey, ip, regexp_matches(ip, '{T.IPV4}') OR regexp_matches(lower(ip), '{T.IPV6}') AS is_ip FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN 'fe80::' || (l_partkey % 10) ELSE (l_partkey % 300) || '.' || (l_suppkey % 256) || '.' || l_linenumber || '.' || CAST(l_quantity AS INT) END AS ip FROM lineitem)")
def ip_literals(spark, folder):
    """TXT-12."""
    ip = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("fe80::"), F.col("l_partkey") % 10)).otherwise(F.concat_ws(".", F.col("l_partkey") % 300, F.col("l_suppkey") % 256, "l_linenumber", F.col("l_quantity").cast("int")))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ip.alias("ip"), T.is_ip(ip).alias("is_ip"))


@q("url_parse", r"""SELECT DISTINCT permalink, regexp_extract(lower(trim(homepage_url)), '^([a-z][a-z0-9+.-]*)://', 1) AS scheme, """ + HOST + r""" AS host, regexp_extract(trim(homepage_url), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]+(/[^?#]*)', 1) AS path, regexp_extract(homepage_url, '[?]([^#]*)', 1) AS query FROM companies WHERE homepage_url IS NOT NULL""")
def url_parse(spark, folder):
    """TXT-13."""
    u = F.col("homepage_url")
    return table(spark, folder, "companies").where("homepage_url is not null").select("permalink", F.regexp_extract(F.lower(F.trim(u)), r"^([a-z][a-z0-9+.-]*)://", 1).alias("scheme"), T.host_of_url(u).alias("host"), F.regexp_extract(F.trim(u), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]+(/[^?#]*)", 1).alias("path"), F.regexp_extract(u, r"[?]([^#]*)", 1).alias("query")).distinct()


@q("whitespace_collapse", r"SELECT entity_id, trim(regexp_replace(name, '\s+', ' ', 'g')) AS name FROM entity_info WHERE name IS NOT NULL")
def whitespace_collapse(spark, folder):
    """TXT-14."""
    return table(spark, folder, "entity_info").where("name is not null").select("entity_id", T.collapse_space(F.col("name")).alias("name"))


@q("sentence_split", r"SELECT doc_id, pos - 1 AS pos, sentence FROM (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL))")
def sentence_split(spark, folder):
    """TXT-15."""
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("bigint"))


TERM = r"^(.+?)(?: @(\S+))?(?: (\(\d+, \d+\)))?$"
TERMS = "SELECT DISTINCT policy_id, trim(target) || CASE WHEN length(target) % 2 = 0 THEN ' @children' ELSE '' END || CASE WHEN length(target) % 3 = 0 THEN ' (' || length(target) || ', 0)' ELSE '' END AS label FROM kg_edges WHERE trim(coalesce(target, '')) <> ''"


@q("term_suffix_parse", f"SELECT policy_id, label, regexp_extract(label, '{TERM}', 1) AS term, regexp_extract(label, '{TERM}', 2) AS subject, regexp_extract(label, '{TERM}', 3) AS src FROM ({TERMS})")
def term_suffix_parse(spark, folder):
    """TXT-16, BLD-13: terms with the suffixes of the graph variants."""
    table(spark, folder, "kg_edges").createOrReplaceTempView("kg_edges")
    t, s, r = T.parse_term(F.col("label"))
    return spark.sql(TERMS).select("policy_id", "label", t.alias("term"), s.alias("subject"), r.alias("src"))


@q("edge_labels", "SELECT DISTINCT policy_id, upper(trim(key)) || '(' || trim(source) || ', ' || trim(target) || ')' AS label, regexp_replace(upper(trim(key)), '^NOT_', '') AS action, starts_with(upper(trim(key)), 'NOT_') AS negative FROM kg_edges WHERE key IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL")
def edge_labels(spark, folder):
    """TXT-17."""
    e = table(spark, folder, "kg_edges").dropna(subset=["key", "source", "target"]).select("policy_id", F.upper(F.trim("key")).alias("k"), F.trim("source").alias("s"), F.trim("target").alias("t"))
    return e.select("policy_id", T.edge_label(F.col("k"), F.col("s"), F.col("t")).alias("label"), F.regexp_replace("k", "^NOT_", "").alias("action"), F.startswith("k", F.lit("NOT_")).alias("negative")).distinct()


@q("capitalised_terms", "SELECT DISTINCT target AS term, upper(target[1]) || substring(target, 2) AS heading FROM kg_edges WHERE target IS NOT NULL AND target <> ''")
def capitalised_terms(spark, folder):
    """TXT-18."""
    return table(spark, folder, "kg_edges").where("target <> ''").select(F.col("target").alias("term"), T.capitalise(F.col("target")).alias("heading")).distinct()


RULES = [("email address", r"\be-?mail\b"), ("phone number", r"\bphone number"), ("location", r"\b(precise|coarse) location|geolocation"), ("ip address", r"\bip address"), ("advertising id", r"\badvertising id"), ("date of birth", r"\bdate of birth"), ("payment", r"\b(payment card|billing)"), ("cookie", r"\bcookie"), ("browsing history", r"\bbrowsing history"), ("device", r"\bdevice (model|identifier)"), ("contact list", r"\bcontact list"), ("gender", r"\bgender\b")]
RULE_SQL = ", ".join(f"('{a}', '(?i){b}')" for a, b in RULES)


@q("keyword_regex_join", f"WITH rules(datatype, pattern) AS (VALUES {RULE_SQL}) SELECT DISTINCT seg_uid, datatype FROM segments JOIN rules ON regexp_matches(text, pattern)")
def keyword_regex_join(spark, folder):
    """TXT-19, EVL-04, JON-10: the rule table is a constant of twelve rows, so it is broadcast."""
    rules = F.broadcast(spark.createDataFrame([(a, f"(?i){b}") for a, b in RULES], "datatype string, pattern string"))
    return table(spark, folder, "segments").select("seg_uid", "text").join(rules, F.expr("text rlike pattern")).select("seg_uid", "datatype").distinct()


@q("char_filters", r"SELECT entity_id, name, regexp_matches(name, '^[\w-]+(\.[\w-]+)+$') AS domain_like, regexp_matches(name, '^[A-Za-z0-9 .,&''-]+$') AS regular, regexp_matches(name, '[A-Z]') AS has_upper FROM entity_info WHERE name IS NOT NULL")
def char_filters(spark, folder):
    """TXT-20."""
    n = F.col("name")
    return table(spark, folder, "entity_info").where("name is not null").select("entity_id", "name", n.rlike(r"^[\w-]+(\.[\w-]+)+$").alias("domain_like"), n.rlike(r"^[A-Za-z0-9 .,&'-]+$").alias("regular"), n.rlike("[A-Z]").alias("has_upper"))


@q("fuzzy_partial")
def fuzzy_partial(spark, folder):
    """TXT-09, JON-11: segments whose sentence is nearly held by an evidence sentence of the same policy."""
    ev = table(spark, folder, "kg_edges").select("policy_id", F.explode("text").alias("sentence")).distinct()
    seg = table(spark, folder, "segments").where("segment_type = 'TEXT' and text is not null").select("policy_id", "seg_uid", "text").dropDuplicates(["seg_uid"])
    return fuzzy.best_partial_matches(ev, seg, left="sentence", right="text", group="policy_id", cutoff=90, top=5).select("policy_id", "sentence", "seg_uid", "score")


HTML = "'<html lang=\"' || coalesce(lang, '') || '\"><head><script>var a = 1;</script><style>p {}</style></head><nav><a href=\"/\">Home</a></nav><article><h1>Privacy policy</h1><p>' || text || '</p></article><footer>(c)</footer></html>'"


def html_pages(spark, folder):
    table(spark, folder, "documents").createOrReplaceTempView("documents")
    return spark.sql(f"SELECT doc_id, {HTML} AS html FROM documents WHERE text IS NOT NULL")


DUCK_STRIP = "html"
for _t in T.BOILERPLATE_TAGS:
    DUCK_STRIP = rf"regexp_replace({DUCK_STRIP}, '(?is)<{_t}\b.*?</{_t}>', '', 'g')"


@q("strip_boilerplate", rf"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace({DUCK_STRIP}, '(?i)<link\b[^>]*>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM (SELECT doc_id, {HTML} AS html FROM documents WHERE text IS NOT NULL)")
def strip_boilerplate(spark, folder):
    """DOC-01."""
    return html_pages(spark, folder).select("doc_id", T.strip_boilerplate(F.col("html")).alias("body"))


@q("main_article", rf"SELECT doc_id, CASE WHEN a <> '' AND regexp_matches(a, '(?i)(data|privacy|cookie)\s*(policy|notice)') THEN a ELSE html END AS main FROM (SELECT *, regexp_extract(html, '(?is)<(?:article|main)\b[^>]*>(.*?)</(?:article|main)>', 1) AS a FROM (SELECT doc_id, {HTML} AS html FROM documents WHERE text IS NOT NULL))")
def main_article(spark, folder):
    """DOC-02."""
    return html_pages(spark, folder).select("doc_id", T.main_article(F.col("html")).alias("main"))


@q("language_gate", "SELECT doc_id, lower(trim(lang)) LIKE 'en%' AS declared FROM documents WHERE lower(trim(lang)) LIKE 'en%'")
def language_gate(spark, folder):
    """DOC-03: pages declared to be English."""
    return table(spark, folder, "documents").where("lower(trim(lang)) like 'en%'").select("doc_id", F.lit(True).alias("declared"))


@q("policy_gate", r"SELECT doc_id, regexp_matches(text, '(?i)(data|privacy)\s*(?:policy|notice)') AS policy FROM documents WHERE text IS NOT NULL")
def policy_gate(spark, folder):
    """DOC-04."""
    return table(spark, folder, "documents").where("text is not null").select("doc_id", T.is_policy(F.col("text")).alias("policy"))


@q("homepage_reject", f"SELECT DISTINCT permalink FROM (SELECT permalink, homepage_url, {HOST} AS host, regexp_extract(trim(homepage_url), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]+(/[^?#]*)', 1) AS path FROM companies WHERE homepage_url <> '') WHERE (len(string_split(host, '.')) = 2 OR starts_with(host, 'www.') AND len(string_split(host, '.')) = 3) AND path IN ('', '/') AND NOT contains(homepage_url, '?')")
def homepage_reject(spark, folder):
    """DOC-05: URLs that only name a home page."""
    u = table(spark, folder, "companies").where("homepage_url <> ''").select("permalink", "homepage_url", T.host_of_url(F.col("homepage_url")).alias("host"), F.regexp_extract(F.trim("homepage_url"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]+(/[^?#]*)", 1).alias("path"))
    n = F.size(F.split("host", r"\."))
    return u.where(((n == 2) | (F.col("host").startswith("www.") & (n == 3))) & F.col("path").isin("", "/") & ~F.col("homepage_url").contains("?")).select("permalink").distinct()


@q("http_error_gate", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = d.doc_id % 100 AND e.event_type = 'error' AND e.ts < TIMESTAMP '2024-01-02')")
def http_error_gate(spark, folder):
    """DOC-06, JON-05: documents whose fetch log holds no error."""
    bad = table(spark, folder, "events").where("event_type = 'error' and ts < timestamp_ntz'2024-01-02'").select(F.col("user_id").alias("u")).distinct()
    return table(spark, folder, "documents").withColumn("u", F.col("doc_id") % 100).join(bad, "u", "left_anti").select("doc_id")


@q("content_dedup", "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def content_dedup(spark, folder):
    """DOC-07, OPT-11, SNK-09: the first copy stands for all; only digests are joined."""
    return P.content_dedup(table(spark, folder, "documents"), "doc_id", "text")


@q("url_keys", "SELECT DISTINCT permalink, sha256(homepage_url) AS digest, replace(replace(to_base64(encode(homepage_url)), '+', '-'), '/', '_') AS safe_id FROM companies WHERE homepage_url IS NOT NULL")
def url_keys(spark, folder):
    """DOC-08, DOC-09."""
    u = F.col("homepage_url")
    return table(spark, folder, "companies").where("homepage_url is not null").select("permalink", F.sha2(u, 256).alias("digest"), F.translate(F.base64(F.encode(u, "UTF-8")), "+/\r\n", "-_").alias("safe_id")).distinct()


META = "'<meta http-equiv=\"refresh\" content=\"0; url=' || homepage_url || '\">'"


@q("meta_refresh", rf"SELECT DISTINCT permalink, regexp_extract(m, '(?i)<meta[^>]*http-equiv=.?refresh.?[^>]*url=([^\">]+)', 1) AS target FROM (SELECT permalink, {META} AS m FROM companies WHERE homepage_url <> '')")
def meta_refresh(spark, folder):
    """DOC-10."""
    table(spark, folder, "companies").createOrReplaceTempView("companies")
    return spark.sql(f"SELECT permalink, {META} AS m FROM companies WHERE homepage_url <> ''").select("permalink", P.meta_refresh_target(F.col("m")).alias("target")).distinct()


@q("nearest_snapshot", "SELECT policy_id, arg_min(page_id, (abs(epoch(fetched_at) - epoch(TIMESTAMP '2024-07-01')), page_id)) AS page_id FROM a11y_tree WHERE fetched_at IS NOT NULL GROUP BY policy_id")
def nearest_snapshot(spark, folder):
    """DOC-11, JON-12: the crawl of each policy nearest to a date."""
    return P.nearest_snapshot(table(spark, folder, "a11y_tree"), "policy_id", "fetched_at", "2024-07-01", "page_id")


@q("redirect_chase", "WITH RECURSIVE e AS (SELECT left_id AS a, min(right_id) AS b FROM entity_pairs WHERE is_match AND left_id <> right_id GROUP BY left_id), hop AS (SELECT a, b, 1 AS hops FROM e UNION ALL SELECT h.a, e.b, hops + 1 FROM hop h JOIN e ON e.a = h.b WHERE hops < 5) SELECT a AS start_id, arg_max(b, hops) AS final_id, max(hops)::INT AS hops FROM hop GROUP BY a")
def redirect_chase(spark, folder):
    """DOC-12: at most five hops along links."""
    e = table(spark, folder, "entity_pairs").where("is_match and left_id <> right_id").groupBy("left_id").agg(F.min("right_id").alias("next"))
    return P.chase(e, "left_id", "next", 5)


@q("first_row_mapping", "SELECT policy_id, doc_id, site FROM documents WHERE policy_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY policy_id ORDER BY doc_id) = 1")
def first_row_mapping(spark, folder):
    """DOC-13, AGG-10: the first document of each policy wins, by a combining aggregation."""
    d = table(spark, folder, "documents").where("policy_id is not null")
    return d.groupBy("policy_id").agg(F.min_by(F.struct("doc_id", "site"), "doc_id").alias("r")).select("policy_id", "r.doc_id", "r.site")


@q("new_urls", f"SELECT DISTINCT host AS site, 'fetch ' || host AS command FROM (SELECT {HOST} AS host FROM companies WHERE homepage_url <> '') WHERE host NOT IN (SELECT site FROM a11y_tree WHERE site IS NOT NULL)")
def new_urls(spark, folder):
    """SNK-10, OPT-12: work for sites that an earlier run hasn't done."""
    done = table(spark, folder, "a11y_tree").select("site").distinct()
    urls = table(spark, folder, "companies").where("homepage_url <> ''").select(T.host_of_url(F.col("homepage_url")).alias("site"))
    return urls.distinct().join(done, "site", "left_anti").withColumn("command", F.concat(F.lit("fetch "), "site"))
