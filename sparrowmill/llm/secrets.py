"""Secret scan with linking of multipart credentials, in SQL functions only.

Strong kinds (assign, access, hex) are always reported. Weak kinds are parts that
mean little alone: e-mail addresses and endpoints, and mixed strings of 20 or more
letters, digits and signs. Parts have roles: access and mail identify, assign, hex
and mixed are secrets, endpoint is one. An interval join inside each text pairs
weak parts with parts that lie at most SCOPE code points before or after them: mail
and endpoint are reported only near a secret, mixed only near an identifier or
endpoint. The join is a merge: with all parts in order of their starts, a running
maximum tells where the last part of each role before one ended, and a running
minimum from the end where the next one begins, so no part is compared with every
other one.

Matches' places come from what lies between them: splitting at a pattern gives
the gaps, extracting gives the matches, and running sums of both lengths the spans.
Running values are found by doubling: n parts take n log n steps.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.storage import table

SCOPE = 200
BLOCK = 2048


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
_LOCAL = "[A-Za-z0-9._%+-]"
#: 253 and 63 characters are what RFC 1035 allows in a domain and in a part of it; they keep the search linear.
_DOMAIN = "@[A-Za-z0-9.-]{1,253}\\.[A-Za-z]{2,63}"
#: A match of _LOCAL+ and _DOMAIN, of any length before the @: it can only begin where such characters begin or the last
#: match ended, and takes all of them, so a long run without @ is read once.
MAIL = f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++{_DOMAIN}"
ENDPOINT = "https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"
MIXED = "[A-Za-z0-9+/_=-]{20,}"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "mail": MAIL, "endpoint": ENDPOINT, "mixed": MIXED}
ORDER = {k: n for n, k in enumerate(KINDS)}
#: What must occur in a text for a kind to be looked for; a quick test before the patterns.
HINTS = {"access": "AKIA", "mail": "@", "endpoint": "://"}
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _running(values: Column, combine, start: int) -> Column:
    """For each place the values up to there combined: each step adds what lies a power of two before."""
    powers = F.expr("transform(sequence(0, 27), k -> shiftleft(1, k))")
    before = lambda acc, p: F.slice(F.concat(F.array_repeat(F.lit(start), p), acc), F.lit(1), F.size(acc))
    return F.aggregate(powers, values, lambda acc, p: F.when(p < F.size(acc), F.zip_with(acc, before(acc, p), combine)).otherwise(acc))


def _matches(text: Column, kind: str) -> list[Column]:
    """The columns _w (what matches the kind), _v (its value) and _g (what lies between matches), null where a quick test finds none."""
    there = text.contains(HINTS[kind]) if kind in HINTS else text.rlike(KINDS[kind])
    of = lambda group: F.regexp_extract_all(text, F.lit(KINDS[kind]), F.lit(group))
    found = {"w": of(0), "g": F.split(text, KINDS[kind])} | ({"v": of(2)} if kind == "assign" else {})
    return [F.when(there, c).alias(f"_{name}_{kind}") for name, c in found.items()]


def _ends(kind: str) -> Column:
    """Where each match ends: what lies before it and the matches so far, summed."""
    sizes = F.zip_with(f"_w_{kind}", f"_g_{kind}", lambda w, g: F.length(w) + F.length(g))
    return _running(sizes, lambda x, y: x + y, 0).alias(f"_e_{kind}")


def _spans(kind: str) -> Column:
    """Structs of start, kind's number and end of all matches, in order, less those that the kind's own rule drops."""
    value = "_v_assign" if kind == "assign" else f"_w_{kind}"
    zipped = F.filter(F.arrays_zip(F.col(f"_w_{kind}").alias("w"), F.col(f"_e_{kind}").alias("e"), F.col(value).alias("v")), lambda x: x["w"].isNotNull())
    found = F.transform(zipped, lambda x: F.struct((x["e"] - F.length(x["w"])).alias("start"), F.lit(ORDER[kind]).alias("kind"), x["e"].alias("end"), x["v"].alias("v")))
    keep = {
        "assign": lambda s: F.length(s["v"]) >= 6,
        "access": lambda s: F.length(s["v"]) >= 20,
        "mixed": lambda s: s["v"].rlike("[a-z]") & s["v"].rlike("[A-Z]") & s["v"].rlike("[0-9]"),
    }.get(kind)
    found = F.filter(found, keep) if keep else found
    bare = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.coalesce(bare, F.expr(f"cast(array() as {SPAN})")).alias(f"_{kind}")


_FAR = 1 << 30


def _is(x: Column, *kinds: str) -> Column:
    return x["kind"].isin(*[ORDER[k] for k in kinds])


def _last_end(parts: Column, kinds: tuple[str, ...]) -> Column:
    """For each part where the last of the kinds that begins no later ends."""
    return _running(F.transform(parts, lambda p: F.when(_is(p, *kinds), p["end"]).otherwise(F.lit(-_FAR))), lambda x, y: F.greatest(x, y), -_FAR)


def _next_start(parts: Column, kinds: tuple[str, ...]) -> Column:
    """For each part where the first of the kinds that begins no earlier starts."""
    return F.reverse(_running(F.transform(F.reverse(parts), lambda p: F.when(_is(p, *kinds), p["start"]).otherwise(F.lit(_FAR))), lambda x, y: F.least(x, y), _FAR))


_SOLID = ("assign", "access", "hex", "mail", "endpoint")
_ROLES = {"secret": ("assign", "hex", "mixed"), "other": ("access", "mail", "endpoint")}


def _chosen(parts: Column, beside: dict[str, Column], keep) -> Column:
    """Those parts for which keep(x) holds, x with the part as p and beside it what the other arrays have there.

    The arrays are zipped, not looked up by place: what is named inside a lambda may be computed anew for each part.
    """
    zipped = F.arrays_zip(parts.alias("p"), *[c.alias(name) for name, c in beside.items()])
    return F.transform(F.filter(zipped, keep), lambda x: x["p"])


def with_spans(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep and text of documents with base and all: arrays of spans by start, then kind.

    The names base and all must not be among keep.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(*keep, text.alias("_t"))
    plain = [k for k in KINDS if k != "mixed"]
    rows = rows.select(*keep, "_t", *[c for k in plain for c in _matches(F.col("_t"), k)])
    rows = rows.select("*", *[_ends(k) for k in plain])
    rows = rows.select(*keep, "_t", *[_spans(k) for k in plain])
    base, weak = F.concat("_assign", "_access", "_hex"), F.concat("_mail", "_endpoint")
    text = F.when(F.size(base) + F.size(weak) > 0, F.col("_t"))  # a mixed string alone is nothing
    rows = rows.select(*keep, "_t", F.array_sort(base).alias("base"), weak.alias("_weak"), *_matches(text, "mixed"))
    rows = rows.select("*", _ends("mixed"))
    rows = rows.select(*keep, "_t", "base", "_weak", _spans("mixed"))
    rows = rows.select(*keep, "_t", "base", F.when(F.size("_weak") + F.size("_mixed") > 0, F.array_sort(F.concat("base", "_weak", "_mixed"))).alias("_parts"))
    parts = F.col("_parts")
    solid = {"last": _last_end(parts, _SOLID), "next": _next_start(parts, _SOLID)}
    alone = _chosen(parts, solid, lambda x: ~_is(x["p"], "mixed") | ((x["last"] <= x["p"]["start"]) & (x["next"] >= x["p"]["end"])))
    rows = rows.select(*keep, "_t", "base", alone.alias("_parts"))
    edges = {f"{name}_{role}": edge(parts, kinds) for role, kinds in _ROLES.items() for name, edge in (("last", _last_end), ("next", _next_start))}
    near = lambda x, role: (x["p"]["start"] - x[f"last_{role}"] <= SCOPE) | (x[f"next_{role}"] - x["p"]["end"] <= SCOPE)
    linked = _chosen(parts, edges, lambda x: F.when(_is(x["p"], "mail", "endpoint"), near(x, "secret")).when(_is(x["p"], "mixed"), near(x, "other")).otherwise(F.lit(True)))
    return rows.select(*keep, "_t", "base", F.coalesce(linked, "base").alias("all"))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == ORDER[kind])


def _digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(shown, ",")


def secret_scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (all, "kind:start:end"), one row for each input row.

    Places count code points, ends are exclusive. Null texts count as empty and hold
    nothing; repeated rows give repeated results; other columns aren't read.
    """
    found = with_spans(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    counts = [F.size(_of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("all")).alias("spans"))


def redacted(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """documents with each reported span replaced by mark (overlapping spans by one) and n_chars, if there, set anew; texts without spans stay as they are, null too."""
    names = [c for c in documents.columns if c != "text"]
    boxed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), F.col("text"))
    found = with_spans(boxed, ["_row"])
    found = found.select("_row", "_t", "all", _running(F.transform("all", lambda s: s["end"]), lambda x, y: F.greatest(x, y), 0).alias("_to"))
    zipped = F.arrays_zip(F.col("all").alias("s"), F.concat(F.array(F.lit(0)), "_to").alias("at"))
    blocks = F.transform(F.sequence(F.lit(0), (F.length("_t") / BLOCK).cast("int")), lambda k: F.col("_t").substr(k * BLOCK + 1, F.lit(BLOCK)))
    found = found.withColumn("_blocks", F.when(F.size("all") > 0, blocks))  # a substring's time grows with its place, so it is taken from its block

    def cut(a: Column, b: Column) -> Column:
        k, n = (a / BLOCK).cast("int"), ((a % BLOCK + b - a) / BLOCK).cast("int") + 1
        near = F.when(n == 1, F.get("_blocks", k)).otherwise(F.array_join(F.slice("_blocks", k + 1, n), ""))
        return near.substr(a % BLOCK + 1, b - a)

    parts = F.transform(zipped, lambda x: F.when(x["s"].isNull(), cut(x["at"], F.length("_t"))).when(x["s"]["start"] >= x["at"], F.concat(cut(x["at"], x["s"]["start"]), F.lit(mark))).otherwise(F.lit("")))
    clean = F.array_join(parts, "")
    new = found.select("_row", F.when(F.size("all") > 0, clean).otherwise(F.col("_row.text")).alias("_new"))
    out = {c: F.col(f"_row.`{c}`") for c in names} | {"text": F.col("_new")}
    if "n_chars" in out:
        out["n_chars"] = F.coalesce(F.length("_new").cast("long"), F.col("_row.n_chars"))
    return new.select(*[out[c].alias(c) for c in documents.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def oracle() -> str:
    """The same scan in DuckDB: gaps and matches unnested, weak parts linked by joins on the gap between them."""
    keep = {
        "assign": f"length(regexp_extract(w, {_sql(ASSIGN)}, 2)) >= 6",
        "access": "length(w) >= 20",
        "mixed": "regexp_matches(w, '[a-z]') and regexp_matches(w, '[A-Z]') and regexp_matches(w, '[0-9]')",
    }
    parts = []
    plain = KINDS | {"mail": f"{_LOCAL}+{_DOMAIN}"}
    for kind, n in ORDER.items():
        p = _sql(plain[kind])
        parts.append(
            f"""select doc_id, s as start, {n} as kind, s + length(w) as stop from (
  select doc_id, ms[i] as w, (list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::int as s
  from (select doc_id, ms, gs, unnest(range(1, len(ms) + 1)) as i from (select doc_id, regexp_extract_all(t, {p}) as ms, string_split_regex(t, {p}) as gs from d) where len(ms) > 0)
) where {keep.get(kind, 'true')}"""
        )
    found = "\nunion all\n".join(parts)
    names = " ".join(f"when {n} then '{k}'" for k, n in ORDER.items())
    digest = f"string_agg(case kind {names} end || ':' || start || ':' || stop, ',' order by start, kind)"
    near = lambda kinds: f"exists (select 1 from p q where q.doc_id = p.doc_id and q.kind in ({kinds}) and q.start - p.stop <= {SCOPE} and p.start - q.stop <= {SCOPE})"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
f as ({found}),
p as (select * from f where kind < 5 or not exists (select 1 from f q where q.doc_id = f.doc_id and q.kind < 5 and q.start < f.stop and f.start < q.stop)),
base as (select * from p where kind < 3),
linked as (select * from base union all select * from p where kind in (3, 4) and {near('0, 2, 5')} union all select * from p where kind = 5 and {near('1, 3, 4')}),
b as (select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, {digest} as s from base group by doc_id),
a as (select doc_id, {digest} as s from linked group by doc_id)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(b.s, '')) as base_sha256, coalesce(a.s, '') as spans
from d left join b using (doc_id) left join a using (doc_id)"""


ORACLE = oracle()
