"""WARC not-modified revisit resolution (operator 6).

A revisit record says "not modified" instead of a body. It resolves to the latest earlier full response
for the same canonical URL, if the validators agree: entity tags where the revisit has one (compared
weakly, RFC 9110), else the last-modified date; a payload digest, where given, must agree too. The headers
are the response's, with those that a 304 response may update taken from the revisit.

The as-of join doesn't sort a URL's whole history in one task: time is cut into chunks that hold `chunk` records on average,
whatever the unit of time (from one pass: how many records there are, and the times between which all but one in a hundred
lie). Per (URL, chunk) the last response is found by an aggregate that is combined before the shuffle; what each chunk starts with is
carried along a URL's chunks, by groups of GROUP chunks first and then inside them, so no window holds more than GROUP rows of a URL until it has
GROUP squared chunks; within (URL, chunk) a window finishes the work. So one URL with a third of all records is spread over its chunks. Records of
one URL at one time share a window. Bodies don't take part: a record carries its digest.

Where records have a status, only a full one (200) answers a revisit; a part, an error or a redirect doesn't, nor does it hide an earlier full
response. Nulls: a record without URL (null or blank) or time resolves to nothing ("no url or time"); null validators count as
absent; null headers as none; a null status as full. Equal times: the smaller record id is the earlier one. Repeated rows are
records of their own: a repeated revisit gets the same answer each time, a repeated response answers as one. An empty table gives an empty result.
Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a 304 response sends of the headers that a 200 response would have (RFC 9110, 15.4.5), and Set-Cookie's absence.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't choose content.
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|sessionid|phpsessid|jsessionid)(=.*)?$"
#: Chunks that a group of chunks holds.
GROUP = 4096


def _decoded(text: Column) -> Column:
    """Percent-encoded unreserved characters as themselves, other encodings in upper case (RFC 3986, 6.2.2); a % that encodes nothing stays."""
    code = lambda part: F.conv(F.substring(part, 1, 2), 16, 10).cast("int")

    def one(part: Column) -> Column:
        plain = F.chr(code(part))
        return F.when(~part.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.lit("%"), part)).when((code(part) < 128) & plain.rlike("^[A-Za-z0-9._~-]$"), F.concat(plain, F.substring(part, 3, 1 << 30))).otherwise(F.concat(F.lit("%"), F.upper(F.substring(part, 1, 2)), F.substring(part, 3, 1 << 30)))

    parts = F.split(text, "%")
    return F.when(~text.contains("%"), text).otherwise(F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, 1 << 30), one), "")))


def _without_dots(path: Column) -> Column:
    """Without "." and ".." segments (RFC 3986, 5.2.4)."""
    step = lambda kept, seg: F.when(seg == ".", kept).when(seg == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(seg)))
    # The first segment is what stands before the first slash: nothing.
    return F.when(~path.contains("/."), path).otherwise(F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def _bare(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")


PATH, QUERY = r"^[^/?]*([^?]*)", r"\?(.*)$"


def _joined(bare: Column, path: Column, query: Column, tracking: str) -> Column:
    """The canonical form of a bare URL with its decoded path and query."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www[0-9]*\.", ""), r":(80|443)$", ""), r"\.$", "")
    path = F.regexp_replace(_without_dots(path), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(tracking)))
    tail = F.when(query == "", F.lit("")).otherwise(F.concat(F.when(F.size(kept) > 0, F.lit("?")).otherwise(F.lit("")), F.array_join(kept, "&")))
    return F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), tail)


def canonical_url(url: Column, tracking: str = TRACKING) -> Column:
    """Host in lower case without www, default port and closing dot; path without fragment, dot segments and last slash; query without tracking
    parameters and in order; percent-encodings only where they are needed. Scheme and userinfo don't count. A blank URL is none (null)."""
    bare = _bare(url)
    return F.when(F.trim(url) != "", _joined(bare, _decoded(F.regexp_extract(bare, PATH, 1)), _decoded(F.regexp_extract(bare, QUERY, 1)), tracking))


def _with_canonical_url(rows: DataFrame) -> DataFrame:
    """The same for rows that have a URL, in steps: what several places of the next step read is worked out once."""
    cut = rows.withColumn("bare", _bare(F.col("url"))).withColumn("path", F.regexp_extract("bare", PATH, 1)).withColumn("query", F.regexp_extract("bare", QUERY, 1))
    whole = cut.withColumn("path", _decoded(F.col("path"))).withColumn("query", _decoded(F.col("query"))).withColumn("url", F.coalesce(_joined(F.col("bare"), F.col("path"), F.col("query"), TRACKING), F.lit("")))  # never null, so nothing asks
    return whole.drop("bare", "path", "query")


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, with the permitted ones of the revisit in their place."""
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(response, none), F.map_filter(F.coalesce(revisit, none), lambda k, v: F.lower(k).isin(*PERMITTED) & v.isNotNull())
    replaced = F.transform(F.map_keys(new), F.lower)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(replaced, F.lower(k))), new)


def _tag(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def resolve(records: DataFrame, *, chunk: int = 4096, group: int = GROUP) -> DataFrame:
    """One row a revisit: (record_id, url, response_id, outcome, headers). records: record_id long, url
    string, at long (time), kind ('response' or 'revisit'), etag, last_modified, digest string, headers
    map<string,string>, and perhaps status int. chunk: records that a chunk of time holds on average."""
    low, high, n = records.agg(F.percentile_approx("at", F.lit(0.005), F.lit(1000)), F.percentile_approx("at", F.lit(0.995), F.lit(1000)), F.count("at")).first()
    length = max(1, (high - low) * chunk // n) if n else 1
    facts = ("record_id", "etag", "last_modified", "digest", "headers")
    answers = F.col("kind") == "response"
    if "status" in records.columns:
        answers = answers & (F.coalesce("status", F.lit(200)) == 200)
    keyed = records.select(*facts, "at", "kind", answers.alias("answers"), "url").withColumn("chunk", F.floor(F.col("at") / length))
    usable = F.coalesce(F.trim("url") != "", F.lit(False)) & F.col("at").isNotNull()
    full = F.when(F.col("answers"), F.struct("at", "record_id", "etag", "last_modified", "digest", F.map_entries("headers").alias("headers")))
    known = _with_canonical_url(keyed.filter(usable)).withColumn("full", full)
    # What a chunk starts with: the last response of any earlier chunk of the URL that has one. Only chunks with records have rows.
    chunks = known.groupBy("url", "chunk").agg(F.max("full").alias("last")).withColumn("group", F.floor(F.col("chunk") / group))
    before = lambda w: F.last("last", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    groups = chunks.groupBy("url", "group").agg(F.max("last").alias("last")).withColumn("earlier", before(W.partitionBy("url").orderBy("group"))).select("url", "group", "earlier")
    inside = chunks.withColumn("carried", before(W.partitionBy("url", "group").orderBy("chunk")))
    starts = inside.join(groups, ["url", "group"]).select("url", "chunk", F.coalesce("carried", "earlier").alias("carried"))
    here = F.last("full", ignorenulls=True).over(W.partitionBy("url", "chunk").orderBy("at", "record_id").rowsBetween(W.unboundedPreceding, -1))
    placed = known.withColumn("here", here).filter(F.col("kind") == "revisit").join(starts, ["url", "chunk"]).withColumn("found", F.coalesce("here", "carried"))
    lost = keyed.filter(~usable & (F.col("kind") == "revisit")).withColumn("url", canonical_url(F.col("url"))).withColumn("found", F.lit(None).cast(placed.schema["found"].dataType))
    columns = [*facts, "url", "at", "found"]
    every = placed.select(*columns).unionByName(lost.select(*columns))
    f = F.col("found")
    agrees = F.when(F.col("etag").isNotNull(), F.coalesce(_tag(F.col("etag")) == _tag(f["etag"]), F.lit(False))).when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == f["last_modified"], F.lit(False)))
    same_body = F.col("digest").isNull() | f["digest"].isNull() | (F.col("digest") == f["digest"])
    outcome = F.when(F.col("url").isNull() | F.col("at").isNull(), "no url or time").when(f.isNull(), "no earlier response").when(agrees.isNull(), "no validator").when(~agrees, "validator differs").when(~same_body, "digest differs").otherwise("resolved")
    done = every.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    return done.select("record_id", "url", F.when(resolved, f["record_id"]).alias("response_id"), "outcome", F.when(resolved, merged_headers(F.map_from_entries(f["headers"]), F.col("headers"))).alias("headers"))


def captures(pages: DataFrame, *, later: int = 500) -> DataFrame:
    """A capture log from pages(page_id, url, html): each page as a full response, and `later` pages on
    a conditional request for the same URL, answered with "not modified", that names its entity tag."""
    body = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    page = pages.select("page_id", "url", body.alias("body"))
    tag = F.concat(F.lit('"'), F.substring("body", 1, 16), F.lit('"'))
    response = page.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 2).alias("at"), F.lit("response").alias("kind"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.col("body").alias("digest"), F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Date"), (F.col("page_id") * 2).cast("string")).alias("headers"))
    again = (F.col("page_id") + later) * 2 + 1
    revisit = page.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", again.alias("at"), F.lit("revisit").alias("kind"), F.concat(F.lit("W/"), tag).alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"), F.create_map(F.lit("date"), again.cast("string"), F.lit("Content-Length"), F.lit("0")).alias("headers"))
    return response.unionByName(revisit)
