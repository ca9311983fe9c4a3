"""Secret scans: base findings, and weak candidates that complementary parts of their scope make credible."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.common import in_arrow, keep, rows_of, sent

#: The base patterns. Letters of ASSIGN in either case; group 2 is the value.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
#: Weak candidates by role.
IDENTIFIER = re.compile(r"""\b(?:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}""", re.IGNORECASE | re.ASCII)
WEAK_SECRET = re.compile(r"""\b(?:pass|pwd|passphrase|credentials?|private_?key|client_?key|auth)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}""", re.IGNORECASE | re.ASCII)
HOST = re.compile(r"""\b(?:host|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{3,}""", re.IGNORECASE | re.ASCII)
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[A-Za-z0-9.-]+[^\s\"'<>]*")
KINDS = ("assign", "access", "hex", "identifier", "weak_secret", "endpoint")
PARTS = "array<struct<kind: int, role: int, start: long, end: long, scope: long, weak: boolean>>"
#: Roles of KINDS: 0 names an account, 1 is a secret, 2 an endpoint.
ROLE = (1, 0, 1, 0, 1, 2)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base findings of one text by start, then kind as listed."""
    found = []
    if "=" in text or ":" in text:
        found += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of candidates that need a counterpart; those inside a base span are none."""
    found = []
    if "=" in text or ":" in text:
        found += [(3, *m.span()) for m in IDENTIFIER.finditer(text)]
        found += [(4, *m.span()) for m in WEAK_SECRET.finditer(text)]
        found += [(4, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) < MIN_ASSIGN]
        found += [(5, *m.span()) for m in HOST.finditer(text)]
    if "AKIA" in text:
        found += [(3, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() < MIN_ACCESS]
    if "://" in text:
        found += [(5, *m.span()) for m in URL.finditer(text)]
    taken, out, at = base, [], 0
    for kind, start, end in sorted(set(found), key=lambda s: (s[1], s[0])):
        while at < len(taken) and taken[at][2] <= start:
            at += 1
        if not any(s <= start and end <= e for _, s, e in taken[at : at + 3]):
            out.append((kind, start, end))
    return out


def blank_lines(text: str) -> list[int]:
    """Starts of the lines of ``text`` that are empty or white space, under every line end."""
    out, at = [], 0
    for line in text.splitlines(keepends=True):
        if line.isspace():
            out.append(at)
        at += len(line)
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document with its base findings and its parts (base and weak) for the link.

    A scope is a block of lines up to one that is empty or white space. Null texts are empty: no findings."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("base", pa.string()),
                            ("parts", pa.list_(pa.struct([("kind", pa.int32()), ("role", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("scope", pa.int64()), ("weak", pa.bool_())])))])
        for batch in rows_of(batches):
            rows = []
            for doc_id, text, text_hash in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py() or ""
                base = base_spans(text)
                weak = weak_spans(text, base)
                parts = []
                if weak:
                    blank = blank_lines(text)
                    for kind, start, end, is_weak in sorted([(*s, False) for s in base] + [(*s, True) for s in weak], key=lambda s: s[1]):
                        parts.append({"kind": kind, "role": ROLE[kind], "start": start, "end": end, "scope": bisect_right(blank, start), "weak": is_weak})
                n = [sum(k == kind for k, _, _ in base) for kind in range(3)]
                joined = _joined(base)
                rows.append({"doc_id": doc_id, "text_hash": text_hash, "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": hashlib.sha256(joined.encode()).hexdigest(), "base": joined, "parts": parts})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")), find, f"doc_id long, text_hash long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, parts {PARTS}")


def linked_spans(parts: DataFrame, reach: int | None = None) -> DataFrame:
    """Weak candidates of ``parts`` (row, kind, role, start, end, scope, weak) with a counterpart in their scope.

    An identifier or an endpoint needs a secret, a weak secret needs one of both, anywhere in the same scope: the scope's
    interval, with the roles that lie in it, meets the candidates in it, and a group's pairs are never made. With a
    ``reach`` the counterpart must also lie at most so many code points away. Then positions fall in cells of ``reach``;
    a cell keeps the first start and the last end of each role, which decide for it and its neighbours whether any part is near enough."""
    need = F.when(F.col("role") == 1, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(1)))
    if reach is None:
        scopes = parts.groupBy("row", "scope").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("role"))).alias("roles"))
        asks = F.when(F.col("role") == 1, 0b101).otherwise(0b010)
        return parts.where("weak").join(scopes, ["row", "scope"]).where(F.col("roles").bitwiseAND(asks) != 0).select("row", "kind", "start", "end").distinct()
    cell = lambda c: F.floor(F.col(c) / F.lit(reach))
    cells = parts.select("row", "scope", "role", "start", "end", F.explode(F.sequence(cell("start"), cell("end"))).alias("cell"))
    near = cells.groupBy("row", "scope", "cell", "role").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    weak = parts.where("weak").withColumn("role", F.explode(need)).withColumn("cell", F.explode(F.sequence(cell("start") - 1, cell("end") + 1)))
    close = (F.col("first") - F.col("end") <= reach) & (F.col("start") - F.col("last") <= reach)
    inner = F.col("cell").between(cell("start"), cell("end"))
    return weak.join(near, ["row", "scope", "cell", "role"]).where(close | inner).select("row", "kind", "start", "end").distinct()


def scan_secrets(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined), n_linked, text_hash for each row.

    Base findings always stay. A weak candidate is reported only where a complementary part co-occurs
    (see linked_spans). Repeated rows and repeated or null ids are answered each; an empty table gives
    no rows; columns other than doc_id and text are not read."""
    scanned = keep(scan(docs).withColumn("row", F.monotonically_increasing_id()), "secrets")
    parts = scanned.where(F.size("parts") > 1).select("row", F.inline("parts"))
    linked = linked_spans(parts, reach).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    both = scanned.drop("parts").join(linked, "row", "left")
    names = F.array(*[F.lit(k) for k in KINDS])
    of_base = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[1].cast("long").alias("start"), (F.array_position(names, F.split(s, ":")[0]) - 1).cast("int").alias("kind"), F.split(s, ":")[2].cast("long").alias("end")))
    every = F.array_sort(F.concat(of_base, F.coalesce("linked", F.array().cast("array<struct<start: long, kind: int, end: long>>"))))
    spans = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    return both.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.when(F.col("linked").isNull(), F.col("base")).otherwise(spans).alias("spans"), F.coalesce(F.size("linked"), F.lit(0)).cast("long").alias("n_linked"), "text_hash")


def redact(text: str | None, spans: str, mark: str = "<SECRET>") -> str | None:
    """``text`` with the spans (kind:start:end, comma-joined, code points) replaced; overlapping ones once."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",")):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every reported span of text replaced by a mark, and n_chars counted anew where that is a column.

    Rows meet their findings by doc_id and the text's hash, so that repeated ids with other texts keep
    apart; all rows and columns stay."""
    found = scan_secrets(docs).where("spans <> ''").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans")).distinct()
    found = sent(keep(found, "findings"))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_hash"]), "left")
    place, spans = joined.columns.index("text"), joined.columns.index("_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            marks = batch.column(spans)
            if marks.null_count < len(marks):
                texts = [redact(t.as_py(), s) if s else t.as_py() for t, s in zip(batch.column(place), marks.to_pylist(), strict=True)]
                batch = batch.set_column(place, "text", pa.array(texts, batch.schema.field(place).type))
            yield batch

    done = in_arrow(joined, run, joined.schema).select(*docs.columns)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
