"""Secret scans with linked parts.

Plain patterns find secrets that stand for themselves. A weaker candidate (a bare token, or a value after
a vague name) counts only when the other parts of a credential, an identifier or an endpoint, are close
to it in the same scope. The scopes are paragraphs; the parts are linked by an interval join.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.llm.common import fresh, map_texts, other_columns
from panelflow.plans.staging import stage

#: Kinds of spans in the order they are listed at equal starts.
KINDS = ["assign", "access", "hex", "linked"]
#: Most code points between a weak candidate and its complement.
REACH = 200

_BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
# Names may carry a prefix that an underscore or a digit joins (``db_user``, ``aws_secret_access_key``).
_IDENTIFIER = re.compile(r"""(?:AKIA[A-Z0-9]{16,}|(?<![a-z])(?:client_?id|(?<!secret_)access_?key(?:_?id)?|account|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?[\w.@-]{3,})""", re.A | re.I)
_ENDPOINT = re.compile(r"""(?:\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{4,}|(?<![a-z])(?:host|endpoint|server|region|url)["']?\x20*[:=]\x20*["']?[\w.:/-]{3,})""", re.A | re.I)
# An ``access_key`` identifies, a ``secret_access_key`` does not.
_NAMED = re.compile(r"""(?<![a-z])(?:pass|pwd|(?:(?<!access_)|(?<=secret_access_))key|auth|credential|cred)s?["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", re.A | re.I)
_BARE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}", re.A)
_SCOPE_END = re.compile(r"\n[^\S\n]*\n")

_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_PART = T.ArrayType(T.StructType([*(T.StructField(n, T.IntegerType()) for n in ("scope", "role", "start", "end"))]))
_IDENTIFIES, _LOCATES, _WEAK_NAMED, _WEAK_BARE = range(4)


def _base_spans(text: str) -> list[tuple[int, int, int]]:
    found = []
    for kind, (pattern, group, least) in enumerate(_BASE.values()):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def _outside(spans: list[tuple[int, int, int]], barred: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Those of ``spans`` that overlap none of ``barred``; both in order of their starts."""
    free, at, taken = [], 0, -1
    for start, end, role in spans:
        while at < len(barred) and barred[at][0] < end:
            taken = max(taken, barred[at][1])
            at += 1
        if start >= taken:
            free.append((start, end, role))
    return free


def _not_alone(text: str, bare: list[tuple[int, int, int]], identifiers: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``bare`` without values joined by ``=`` to an identifier's name that have no other identifier within reach."""
    free, at = [], 0
    for start, end, role in bare:
        while at < len(identifiers) and identifiers[at][1] <= start:
            at += 1
        if text[start - 1 : start] == "=" and at < len(identifiers) and identifiers[at][0] < start:
            beside = [identifiers[i] for i in (at - 1, at + 1) if 0 <= i < len(identifiers)]
            if not any(s <= end + REACH and e >= start - REACH and not _SCOPE_END.search(text, min(s, start), max(s, start) + 1) for s, e, _ in beside):
                continue
        free.append((start, end, role))
    return free


def _parts(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Weak candidates outside base spans, and what could complement them, with the number of their paragraph."""
    named = _outside([(m.start(), m.end(), _WEAK_NAMED) for m in _NAMED.finditer(text)], [(start, end) for start, _, end in base])
    # A long name in front of a value looks like a bare token: the named value goes first.
    barred = sorted([(start, end) for start, _, end in base] + [(start, end) for start, end, _ in named])
    bare = _outside([(m.start(), m.end(), _WEAK_BARE) for m in _BARE.finditer(text)], barred)
    if not named and not bare:
        return []
    identifiers = [(m.start(), m.end(), _IDENTIFIES) for m in _IDENTIFIER.finditer(text)]
    others = identifiers + [(m.start(), m.end(), _LOCATES) for m in _ENDPOINT.finditer(text)]
    if not others:
        return []
    free = named + _not_alone(text, bare, identifiers)
    breaks, scope, out = [m.start() for m in _SCOPE_END.finditer(text)], 0, []
    for start, end, role in sorted(free + others):
        while scope < len(breaks) and breaks[scope] < start:
            scope += 1
        out.append({"scope": scope, "role": role, "start": start, "end": end})
    return out


def _scan(texts: pa.Array) -> dict[str, pa.Array]:
    spans, parts, counts = [], [], {"n_assign": [], "n_access": [], "n_hex": []}
    for text in texts.to_pylist():
        base = _base_spans(text)
        spans.append([{"kind": k, "start": s, "end": e} for s, k, e in base])
        for i, n in enumerate(counts):
            counts[n].append(sum(k == i for _, k, _ in base))
        parts.append(_parts(text, base))
    out = {n: pa.array(v, pa.int64()) for n, v in counts.items()}
    return out | {"base": pa.array(spans, pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "end")]))), "parts": pa.array(parts, pa.list_(pa.struct([(n, pa.int32()) for n in ("scope", "role", "start", "end")])))}


def scan(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Base spans and candidate parts of every text, with ``text_key``, which stands for equal texts."""
    fields = [*(T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")), T.StructField("base", _SPAN), T.StructField("parts", _PART)]
    keep = [c for c in keep if c in other_columns(docs, {f.name for f in fields} | {"text_key"})]
    rows = docs.withColumn("text_key", text_key(text_col))
    return map_texts(rows, text_col, fields, _scan, [*keep, "text_key"])


def text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")))


def link(scanned: DataFrame, reach: int = REACH) -> DataFrame:
    """``text_key, linked``: weak candidates whose complement is within ``reach`` in the same paragraph.

    A bare token needs an identifier, a named value an identifier or an endpoint. Complements are first
    reduced to their extent for each paragraph, role and bucket of ``reach`` code points that they touch.
    A candidate meets the buckets its surroundings touch, so the join is linear in the length of the parts,
    however many or long they are. Both touch the same bucket, so the extent is as good as the parts.
    """
    parts = scanned.filter(F.size("parts") > 0).select("text_key", F.explode("parts").alias("p")).select("text_key", "p.*")
    touched = F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach))
    others = parts.filter(F.col("role") < _WEAK_NAMED).withColumn("bucket", F.explode(touched)).groupBy("text_key", "scope", "role", "bucket")
    others = others.agg(F.min("start").alias("first"), F.max("end").alias("last"))
    weak = parts.filter(F.col("role") >= _WEAK_NAMED).distinct().withColumnRenamed("role", "weak")
    near = F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("end") + reach) / reach))
    met = weak.withColumn("bucket", F.explode(near)).join(others, ["text_key", "scope", "bucket"])
    met = met.filter((F.col("first") <= F.col("end") + reach) & (F.col("last") >= F.col("start") - reach))
    met = met.filter((F.col("weak") == _WEAK_NAMED) | (F.col("role") == _IDENTIFIES))
    span = F.struct(F.lit(KINDS.index("linked")).alias("kind"), "start", "end")
    return met.groupBy("text_key").agg(F.collect_set(span).alias("linked"))


def _joined(spans: Column) -> Column:
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def find(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Counts of base kinds, ``base_sha256``, ``n_linked`` and ``spans`` for every row, with the columns in ``keep``.

    A null text counts as empty. Equal texts share their spans. Spans are ``kind:start:end`` in code points,
    by start and then by kind, joined by commas; with none it is the empty string. Long texts are searched whole.
    Columns in ``keep`` that are named like a result are replaced by it. An empty table gives an empty one.
    """
    keep = [c for c in keep if c.lower() not in ("base_sha256", "n_linked", "spans", "linked")]
    scanned = stage(scan(docs, keep, text_col), "scanned")
    # Texts without parts, copies of hot ones too, need no join and stay where they are.
    rows = scanned.filter(F.size("parts") > 0).drop("parts").join(link(scanned), "text_key", "left")
    rows = rows.unionByName(scanned.filter(F.size("parts") == 0).drop("parts"), allowMissingColumns=True)
    linked = F.coalesce("linked", F.array().cast(_SPAN))
    return rows.select(
        *[c for c in scanned.columns if c not in ("text_key", "base", "parts")],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        F.size(linked).cast("long").alias("n_linked"),
        _joined(F.concat("base", linked)).alias("spans"),
        "text_key",
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every found span replaced by ``[SECRET]``; overlapping spans become one.

    Null texts stay null; other columns pass whatever they are called; repeated rows stay as many as they are. An empty
    table gives an empty one.
    """
    found = find(docs, [], text_col).filter("spans != ''").select("text_key", "spans").distinct()
    key, listed = fresh(docs, "__key__"), fresh(docs, "__spans__")
    hit = docs.withColumn(key, text_key(text_col)).join(found.withColumnsRenamed({"text_key": key, "spans": listed}), key, "left")
    columns = docs.columns

    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist()):
            if text is None or not own:
                out.append(text)
                continue
            pieces, at = [], 0
            for _, start, end in (s.split(":") for s in own.split(",")):
                if int(start) >= at:
                    pieces += [text[at : int(start)], "[SECRET]"]
                at = max(at, int(end))
            out.append("".join(pieces) + text[at:])
        return pa.array(out, pa.string())

    def run(batches):
        for b in batches:
            texts = cut(b.column(columns.index(text_col)), b.column(len(columns)))
            yield pa.RecordBatch.from_arrays([texts if c == text_col else b.column(i) for i, c in enumerate(columns)], names=columns)

    return hit.select(*[f"`{c}`" for c in columns], listed).mapInArrow(run, docs.schema)
