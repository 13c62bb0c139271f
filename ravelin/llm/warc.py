"""WARC derivatives: response records -> linked metadata and plain-text conversion records.

``read_warc`` reads the records of WARC files, plain or gzip, record by record (Spark splits plain files); ``responses`` makes
response records of fetched pages; ``derive`` makes of each response one ``metadata`` record (application/warc-fields: source
headers, digests, title, language, lengths) and one ``conversion`` record (text/plain). Both name the response in
WARC-Refers-To, keep its target URI, date and payload digest, and have ids made from its id, so a second run gives the same
records. All of it is DataFrame expressions: each record depends on its own row only, so there is no shuffle and no skew.

Results: a null body is empty (its conversion has an empty block); null URIs are empty; line breaks within header values become
a space, so no value can forge a header; numeric entities and the named ones of HTML 4 are decoded once, others stay; repeated
rows give repeated records; records that are no responses are passed over; a file without records gives none; extra columns are
left alone."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Patterns that turn HTML into text, applied in this order.
HTML_STEPS = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<(script|style|noscript|template)[^>]*>.*?</(script|style|noscript|template)[^>]*>", ""),
    (r"(?i)</?(p|div|h[1-6]|li|ul|ol|br|hr|article|section|nav|header|footer|main|aside|table|tr|title|blockquote|pre)([ /][^>]*)?>", "\n"),
    (r"<[^>]*>", " "),
]
ENTITY = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"
SPACE_STEPS = [(r"[ \t\x0B\f\r\x{00A0}]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+", ""), (r"[ \n]+$", "")]


def entities(text: Column) -> Column:
    """The entities of a text with the characters they stand for: ampersands last, so that nothing is decoded twice."""
    names = F.create_map(*(x for name, code in sorted(name2codepoint.items()) for x in (F.lit(name), F.lit(code).cast("long"))))

    def code(e: Column) -> Column:
        number = F.when(e.rlike("^#[xX]"), F.conv(F.substring(e, 3, 6), 16, 10)).when(e.startswith("#"), F.substring(e, 2, 7)).cast("long")
        return F.coalesce(number, F.try_element_at(names, e))

    found = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1))), lambda e: F.struct(e.alias("e"), code(e).alias("code")))
    known = F.filter(found, lambda x: x.code.between(1, 0xD7FF) | x.code.between(0xE000, 0x10FFFF))
    said = lambda x: F.decode(F.unhex(F.lpad(F.hex(x.code), 8, "0")), "UTF-32")
    return F.array_sort(F.transform(known, lambda x: F.struct((x.code == 38).alias("last"), F.concat(F.lit("&"), x.e, F.lit(";")).alias("mark"), said(x).alias("char"))))


def with_text(rows: DataFrame, html: str, name: str) -> DataFrame:
    """With the plain text of an HTML column. Each step is a column of its own, so that no step is computed twice."""
    bare = F.col(html)
    for pattern, by in HTML_STEPS:
        bare = F.regexp_replace(bare, F.lit(pattern), F.lit(by))
    rows = rows.withColumn("_bare", bare)
    rows = rows.withColumn("_marks", F.when(F.col("_bare").contains("&"), entities(F.col("_bare"))))
    plain = F.when(F.size("_marks") > 0, F.aggregate("_marks", F.col("_bare"), lambda t, x: F.replace(t, x.mark, x.char))).otherwise(F.col("_bare"))
    for pattern, by in SPACE_STEPS:
        plain = F.regexp_replace(plain, F.lit(pattern), F.lit(by))
    return rows.withColumn(name, plain).drop("_bare", "_marks")


def one_line(value: Column) -> Column:
    """A header's value: null is empty, and line breaks become a space."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), "[\r\n]+", " ")


def urn(*parts: Column) -> Column:
    """A record id from the md5 of some values, in the form of a UUID."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records: key, record_type, record_id, target_uri, warc_date, payload_digest (null: none), http_headers, body."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    uri = one_line(F.col(url_col))
    return pages.select(F.col(id_col).alias("key"), F.lit("response").alias("record_type"), urn(F.coalesce(F.col(id_col).cast("string"), F.lit("")), uri, F.lit("response")).alias("record_id"), uri.alias("target_uri"), F.lit(date).alias("warc_date"), F.lit(None).cast("string").alias("payload_digest"), F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF)).alias("http_headers"), body.alias("body"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of WARC files (.warc, .warc.gz): key (the record id), record_type, record_id, target_uri, warc_date,
    payload_digest, http_headers, body (text, by the charset that the HTTP headers name, ISO-8859-1 or else UTF-8) and
    ``complete``, false where a block has not the length that its header gives. A record ends where the next one's version
    line begins, so a block that holds such a line after an empty one is not complete."""
    rows = spark.read.text(path, lineSep="\r\n\r\nWARC/1.")
    raw = F.decode(F.col("value").cast("binary"), "ISO-8859-1")  # a character for each byte
    rows = rows.select(raw.alias("raw")).filter(F.trim(F.regexp_replace("raw", r"\s+", " ")) != "")
    rows = rows.withColumn("stop", F.instr("raw", CRLF * 2))
    utf8 = lambda c: F.make_valid_utf8(F.encode(c, "ISO-8859-1").cast("string"))
    head = F.when(F.col("stop") > 0, F.substring("raw", F.lit(1), F.col("stop") - 1)).otherwise(F.col("raw"))
    rows = rows.withColumn("lines", F.split(F.regexp_replace(utf8(head), "\r\n[ \t]+", " "), CRLF, -1))

    def header(name: str) -> Column:
        own = F.filter("lines", lambda line: F.lower(line).startswith(f"{name}:"))
        return F.trim(F.substring(F.get(own, F.lit(0)), F.lit(len(name) + 2), F.length(F.get(own, F.lit(0)))))

    size = F.coalesce(header("content-length").try_cast("int"), F.lit(0))
    rows = rows.select("raw", "stop", size.alias("size"), *(header(f"warc-{name}").alias(name) for name in ("type", "record-id", "target-uri", "date", "payload-digest")))
    rows = rows.withColumn("block", F.when(F.col("stop") > 0, F.substring("raw", F.col("stop") + 4, F.col("size"))).otherwise(""))
    rows = rows.withColumn("cut", F.when(F.col("type") == "response", F.instr("block", CRLF * 2)).otherwise(0))
    http = F.when(F.col("cut") > 0, F.substring("block", F.lit(1), F.col("cut") + 1)).otherwise("")
    body = F.when(F.col("cut") > 0, F.substring("block", F.col("cut") + 4, F.length("block"))).otherwise(F.col("block"))
    text = F.when(F.lower(http).rlike("charset=\"?(iso-8859-1|latin1)"), body).otherwise(utf8(body))
    return rows.select(F.col("record-id").alias("key"), F.col("type").alias("record_type"), F.col("record-id").alias("record_id"), F.coalesce("target-uri", F.lit("")).alias("target_uri"), F.col("date").alias("warc_date"), F.col("payload-digest").alias("payload_digest"), utf8(http).alias("http_headers"), text.alias("body"), (F.length("block") == F.col("size")).alias("complete"))


def derive(records: DataFrame) -> DataFrame:
    """Two records a response: key, record_type, record_id, refers_to, target_uri, warc_date, content_type, block,
    content_length, block_digest, payload_digest (the source's, or made from its body) and warc_headers."""
    rows = records.filter("record_type = 'response'").select("key", "record_id", one_line(F.col("target_uri")).alias("target_uri"), "warc_date", "payload_digest", F.regexp_replace(F.coalesce("http_headers", F.lit("")), "\r\n[ \t]+", " ").alias("http_headers"), F.coalesce("body", F.lit("")).alias("body"))
    rows = rows.withColumn("payload_digest", F.coalesce(F.col("payload_digest"), F.concat(F.lit("sha256:"), F.sha2("body", 256))))
    rows = with_text(rows, "body", "plain")
    title = F.trim(one_line(F.regexp_extract("body", r"(?is)<title[^>]*>([^<]*)</title>", 1)))
    lang = F.lower(F.regexp_extract("body", r"(?i)<html[^>]* lang=\"?([A-Za-z-]+)", 1))
    status = F.regexp_extract("http_headers", r"^HTTP/[0-9.]+ ([0-9]+)", 1)
    lines = F.filter(F.slice(F.split("http_headers", CRLF, -1), 2, 1_000), lambda line: line != "")
    sent = F.array_join(F.transform(lines, lambda line: F.concat(F.lit("http-header: "), one_line(line), F.lit(CRLF))), "")
    fields = [("source-record-id", F.col("record_id")), ("source-payload-digest", F.col("payload_digest")), ("http-status", status), ("source-length", F.octet_length("body").cast("string")), ("title", title), ("language", lang), ("text-length", F.octet_length("plain").cast("string"))]
    meta = F.concat(*(x for name, value in fields for x in (F.lit(f"{name}: "), value, F.lit(CRLF))), sent)
    record = lambda name, content, block: F.struct(F.lit(name).alias("record_type"), F.lit(content).alias("content_type"), block.alias("block"))
    pair = F.array(record("metadata", "application/warc-fields", meta), record("conversion", "text/plain; charset=utf-8", F.col("plain")))
    out = rows.select("key", F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "payload_digest", F.explode(pair).alias("r")).select("key", "refers_to", "target_uri", "warc_date", "payload_digest", "r.*")
    out = out.withColumns({"record_id": urn(F.col("refers_to"), F.col("record_type")), "content_length": F.octet_length("block").cast("long"), "block_digest": F.concat(F.lit("sha256:"), F.sha2("block", 256))})
    head = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    headers = F.concat(F.lit(f"WARC/1.1{CRLF}"), *(x for name, c in head for x in (F.lit(f"{name}: "), F.col(c).cast("string"), F.lit(CRLF))))
    return out.select("key", "record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "payload_digest", headers.alias("warc_headers"), "block")


def serialise(records: DataFrame) -> DataFrame:
    """One ``record`` (binary) a row, as it stands in a WARC file."""
    return records.select(F.concat(F.col("warc_headers"), F.lit(CRLF), F.col("block"), F.lit(CRLF + CRLF)).cast("binary").alias("record"))


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The records of a WARC file: headers and block."""
    out, at = [], 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split(CRLF)
        headers = {name: value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        size = int(headers["Content-Length"])
        out.append((headers, data[stop + 4 : stop + 4 + size]))
        at = stop + 4 + size + 4
    return out


def _sql_string(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    def text(x: str) -> str:
        for pattern, by in HTML_STEPS:
            x = f"regexp_replace({x}, {_sql_string(pattern)}, {_sql_string(by) if by != chr(10) else 'chr(10)'}, 'g')"
        x = f"(select case when contains(h, '&') then list_reduce(list_prepend(list_reduce(list_prepend(h, [e for e in f if codes[e] <> 38]), lambda t, e: replace(t, '&' || e || ';', chr(codes[e]::int))), [e for e in f if codes[e] = 38]), lambda t, e: replace(t, '&' || e || ';', '&')) else h end from (select h, codes, list_filter(list_distinct(regexp_extract_all(h, '{ENTITY}', 1)), lambda e: codes[e] between 1 and 55295 or codes[e] between 57344 and 1114111) f from (select h, map_from_entries(list_transform(list_distinct(regexp_extract_all(h, '{ENTITY}', 1)), lambda e: row(e, case when e[1] <> '#' then named.m[e] when lower(e[2]) = 'x' then ('0x' || e[3:])::bigint else e[2:]::bigint end))) codes from (select {x} h))))"
        for pattern, by in SPACE_STEPS:
            x = f"regexp_replace({x}, {_sql_string(pattern)}, {_sql_string(by) if by != chr(10) else 'chr(10)'}, 'g')"
        return x

    uuid = lambda x: f"(with h as (select md5({x}) m) select '<urn:uuid:' || m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] || '>' from h)"
    n = "chr(13) || chr(10)"
    return f"""
with named as (select map {{{', '.join(f"'{k}': {v}::bigint" for k, v in sorted(name2codepoint.items()))}}} m),
r as (select page_id, regexp_replace(coalesce(url, ''), '[\\r\\n]+', ' ', 'g') target_uri, coalesce(html, '') body from pages),
s as (select *, {uuid("coalesce(page_id::varchar, '') || '|' || target_uri || '|response'")} refers_to, 'sha256:' || sha256(body) payload_digest, {text("body")} plain from r, named),
m as (select *, 'source-record-id: ' || refers_to || {n} || 'source-payload-digest: ' || payload_digest || {n} || 'http-status: 200' || {n} || 'source-length: ' || strlen(body) || {n} || 'title: ' || trim(regexp_replace(regexp_extract(body, '(?is)<title[^>]*>([^<]*)</title>', 1), '[\\r\\n]+', ' ', 'g')) || {n} || 'language: ' || lower(regexp_extract(body, '(?i)<html[^>]* lang="?([A-Za-z-]+)', 1)) || {n} || 'text-length: ' || strlen(plain) || {n} || 'http-header: Content-Type: text/html; charset=utf-8' || {n} || 'http-header: Content-Length: ' || strlen(body) || {n} meta from s),
d as (select page_id, refers_to, target_uri, payload_digest, 'metadata' record_type, 'application/warc-fields' content_type, meta block from m
  union all select page_id, refers_to, target_uri, payload_digest, 'conversion', 'text/plain; charset=utf-8', plain from m),
e as (select *, '1970-01-01T00:00:00Z' warc_date, {uuid("refers_to || '|' || record_type")} record_id, strlen(block) content_length, 'sha256:' || sha256(block) block_digest from d)
select page_id, record_type, record_id, refers_to, target_uri, warc_date, content_type, content_length, block_digest, payload_digest,
  'WARC/1.1' || {n} || 'WARC-Type: ' || record_type || {n} || 'WARC-Record-ID: ' || record_id || {n} || 'WARC-Refers-To: ' || refers_to || {n} || 'WARC-Target-URI: ' || target_uri || {n} || 'WARC-Date: ' || warc_date || {n} || 'WARC-Block-Digest: ' || block_digest || {n} || 'WARC-Payload-Digest: ' || payload_digest || {n} || 'Content-Type: ' || content_type || {n} || 'Content-Length: ' || content_length || {n} warc_headers, block
from e"""
