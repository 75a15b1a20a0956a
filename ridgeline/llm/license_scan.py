"""Licence scans by canonical digest lookup.

A text and every known licence are brought to one canonical form (case, copyright notices, punctuation,
white space, equivalent spellings), and whole texts are joined with the known licences on its digest. Single
lines of a text can be looked up the same way, for notices that stand alone in a line. All of it is built-in
expressions, in one pass over the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import attach, durable, fresh, identity, named, table
from ridgeline.llm.license_long_texts import LONG, NOTICES
from ridgeline.llm.license_texts import KNOWN

#: Words that count as equal in licence texts.
WORDS = {
    "acknowledgement": "acknowledgment", "acknowledgements": "acknowledgments", "analogue": "analog", "analyse": "analyze",
    "artefact": "artifact", "artefacts": "artifacts", "authorisation": "authorization", "authorise": "authorize", "authorised": "authorized",
    "cancelled": "canceled", "catalogue": "catalog", "centre": "center", "emphasised": "emphasized", "favour": "favor",
    "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http", "initialise": "initialize",
    "judgement": "judgment", "labelled": "labeled", "labelling": "labeling", "licence": "license", "licences": "licenses",
    "licenced": "licensed", "maximise": "maximize", "minimise": "minimize", "modelled": "modeled", "optimise": "optimize",
    "organisation": "organization", "organisations": "organizations", "owner": "holder", "owners": "holders", "programme": "program",
    "programmes": "programs", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilise": "utilize",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}
#: The same for several words, after WORDS.
PHRASES = [("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("sub license", "sublicense"), ("per cent", "percent")]
#: Most rows of a list of licences that is broadcast; the packaged one has about 1,500.
BROADCAST_ROWS = 100_000
#: Most digests that lines are held against while they are made, before the join.
LISTED = 10_000


def _notice() -> str:
    """A line that is a copyright notice, lower case, in the syntax that Java and RE2 share.

    A line of body text that merely begins with "copyright" is none, nor is a list item "(c)" or a line too long for
    a notice: a text may be wrapped anywhere.
    """
    rest, apart = r"[^\n]{0,300}", r"(?:[^0-9a-z_\n][^\n]{0,300})?"  # anything; anything that does not go on with the word
    mark = r"(?:\(c\)|©|&copy;)"
    year = rf"[<\[{{(]?(?:(?:19|20)[0-9]{{2}}{apart}|(?:yyyy|year){rest})"  # a year, or the place for one in a template
    reserved = r"all[ ]rights[ ]reserved[^0-9a-z_\n]*"
    kinds = [
        rf"(?:copyright|copr\.)[ \t:,]*(?:{mark}{rest}|{year}|by{apart})",
        rf"{mark}[ \t:,]*(?:copyright{apart}|{year})",
        rf"©{rest}",
        rf"(?:copyright|{mark})[^0-9a-z_\n](?:[^\n]{{0,300}}[^0-9a-z_\n])?{reserved}",
        rf"{reserved}(?:(?:{mark}|copyright[ \t:,]*{mark}){rest}|(?:copyright[ \t:,]*)?{year}|by{apart})?",
    ]
    return rf"[ \t#*/;-]*(?:{'|'.join(kinds)})"


NOTICE = _notice()


def forms(docs: DataFrame, text: str, form: str, whole: str, lines: str) -> DataFrame:
    """docs with the canonical form, the form that keeps its notices, and the forms of its lines.

    A form is lower-case words of letters and digits with single spaces, with equivalent spellings replaced; a null
    text counts as empty. A line that is a notice has the empty form.
    """
    low, clean, raw = fresh(docs, "scan_low", "scan_clean", "scan_raw")
    spelled = F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair])

    def joined(parts: Column) -> Column:
        """Parts that may be empty as one form."""
        return phrased(F.array_join(F.filter(parts, lambda x: x != ""), " "))

    def phrased(t: Column) -> Column:
        for old, new in PHRASES:
            t = F.replace(t, F.lit(old), F.lit(new))
        return t

    out = docs.withColumn(low, F.regexp_replace(F.lower(F.coalesce(named([text])[0].cast("string"), F.lit(""))), r"\r\n?", "\n"))
    tokens = F.split(F.replace(F.regexp_replace(low, r"[^\p{L}\p{N}\n]+", " "), F.lit("\n"), F.lit(" \n ")), " ")
    # A hash set says which words are respelled; only these are looked for in the map, one entry after the other.
    respell = lambda w: F.when(w.isin(list(WORDS)), F.try_element_at(spelled, w)).otherwise(w)
    respelled = F.array_join(F.transform(F.filter(tokens, lambda w: w != ""), respell), " ")
    out = out.withColumns({clean: F.transform(F.split(respelled, "\n", -1), lambda x: F.trim(x)), raw: F.split(low, "\n", -1)})
    body = F.transform(clean, lambda x, k: F.when(F.get(F.col(raw), k).rlike(f"^{NOTICE}$"), "").otherwise(x))
    return out.withColumn(low, body).select(*named(docs.columns), joined(F.col(low)).alias(form), joined(F.col(clean)).alias(whole), F.transform(low, phrased).alias(lines))


def known_licenses(spark, texts: dict[str, str] | None = None) -> DataFrame:
    """(license_id, digest, size), by default of the packaged list: size is the length of the canonical form.

    A text that has notices of its own has a second row, with them: that form does not depend on line breaks.
    """
    listed = [*KNOWN.items(), *LONG.items(), *NOTICES] if texts is None else list(texts.items())
    both = forms(spark.createDataFrame(listed, "license_id string, text string"), "text", "form", "whole", "lines")
    each = both.select("license_id", F.explode(F.array("form", "whole")).alias("form"))
    return durable(each.select("license_id", F.sha2("form", 256).alias("digest"), F.length("form").alias("size")).distinct())


def _digests(docs: DataFrame, known: DataFrame, text: str, form: str, whole: str, lines: str) -> DataFrame:
    """docs with the digests of its forms: null where empty, and of lines only those that can be known."""
    sizes = sorted({r["size"] for r in known.select("size").distinct().limit(LISTED + 1).toLocalIterator()})
    listed = [r["digest"] for r in known.select("digest").distinct().limit(LISTED + 1).toLocalIterator()]
    out = forms(docs, text, form, whole, lines)
    digest = lambda c: F.when(c != "", F.sha2(c, 256))
    # Of long lists not all are compared here: a line that is not known finds no partner in the join either.
    likely = F.filter(F.array_distinct(lines), lambda x: (x != "") & (F.length(x).isin(sizes) if len(sizes) <= LISTED else F.lit(True)))
    found = F.transform(likely, lambda x: F.sha2(x, 256))
    if len(listed) <= LISTED:
        found = F.filter(found, lambda x: x.isin(listed))
    return out.withColumns({form: digest(F.col(form)), whole: digest(F.col(whole)), lines: F.array_distinct(found)})


def _looked_up(out: DataFrame, known: DataFrame, form: str, whole: str, answer: str) -> DataFrame:
    """out with the licence of either digest, the smallest id of several, that of the form first."""
    key, one, two = fresh(out, "known_digest", "known_id", "other_id")
    first = known.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    first = durable(first)
    side = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    for digest, name in ((form, one), (whole, two)):
        ids = side.select(F.col("digest").alias(key), F.col("license_id").alias(name))
        out = out.join(ids, F.col(digest) == F.col(key), "left").drop(key)
    return out.withColumn(answer, F.coalesce(one, two)).drop(one, two)


def scan(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """docs with license_digest and license_id, null where the whole text is no known licence.

    Of several ids with one digest the smallest counts. A text that is empty in canonical form (null, blank,
    copyright notices only) has no digest and matches nothing. Rows stay one for one, repeated ones too; an empty table
    gives an empty result. Columns of docs with the added names are replaced.
    """
    kept = docs.select(*named([c for c in docs.columns if c.lower() not in ("license_digest", "license_id")]))
    whole, lines = fresh(kept, "whole_digest", "line_digests")
    out = _digests(kept, known, text, "license_digest", whole, lines).drop(lines)
    return _looked_up(out, known, "license_digest", whole, "license_id").drop(whole)


def scan_lines(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license_id), distinct: lines of a text that are a known notice as a whole.

    A null text has none. A null doc_id is an id like any other: rows that repeat an id share its licences.
    """
    rows = docs.select(named([doc_id])[0].alias("doc_id"), named([text])[0].alias("text"))
    lines = _digests(rows, known, "text", "form", "whole", "lines").select("doc_id", F.explode("lines").alias("digest"))
    return lines.join(known.select("digest", "license_id"), "digest").select("doc_id", "license_id").distinct()


def scan_all(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license_digest, license_id, line_licenses (ids, comma between, null if none) for every row of docs.

    scan and scan_lines from one pass over the texts. Line licences go by row, so rows with a null or repeated
    doc_id have those of their own text.
    """
    rows = docs.select(named([doc_id])[0].alias("doc_id"), named([text])[0].alias("text"))
    marked = _digests(rows.withColumn("identity", identity(F.col("doc_id"), F.col("text"))), known, "text", "license_digest", "whole", "lines").drop("text")
    marked = durable(marked)
    lines = marked.where(F.size("lines") > 0).groupBy("identity").agg(F.first("lines").alias("lines"), F.count("*").alias("rows")).select("identity", "rows", F.explode("lines").alias("digest"))
    found = lines.join(known.select("digest", "license_id"), "digest").groupBy("identity").agg(F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("line_licenses"), F.first("rows").alias("rows"))
    looked = _looked_up(marked, known, "license_digest", "whole", "license_id").select("doc_id", "identity", "license_digest", "license_id", F.size("lines").alias("n_lines"))
    with_lines = attach(looked.where("n_lines > 0"), durable(found), "identity", "rows")
    shown = ("doc_id", "license_digest", "license_id", "line_licenses")
    return looked.where("n_lines = 0").withColumn("line_licenses", F.lit(None).cast("string")).select(*shown).unionByName(with_lines.select(*shown))


def query(spark, sf_dir: str) -> DataFrame:
    return scan_all(table(spark, sf_dir, "documents"), known_licenses(spark))


def _sql() -> str:
    def quote(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def form(column: str, notices: bool = False) -> str:
        t = f"replace(replace(lower(coalesce({column}, '')), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
        if not notices:
            t = f"regexp_replace({t}, {quote(f'(?m)^{NOTICE}$')}, '', 'g')"
        t = f"trim(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        cases = " ".join(f"WHEN {quote(a)} THEN {quote(b)}" for a, b in WORDS.items())
        t = f"array_to_string(list_transform(string_split({t}, ' '), lambda w: CASE w {cases} ELSE w END), ' ')"
        for old, new in PHRASES:
            t = f"replace({t}, {quote(old)}, {quote(new)})"
        return t

    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in [*KNOWN.items(), *LONG.items(), *NOTICES])
    return f"""
WITH t AS (SELECT * FROM (VALUES {values}) AS v(license_id, text)),
k AS (SELECT DISTINCT * FROM (SELECT license_id, sha256({form('text')}) AS digest FROM t UNION ALL SELECT license_id, sha256({form('text', True)}) FROM t)),
one AS (SELECT digest, min(license_id) AS license_id FROM k GROUP BY 1),
d AS (SELECT doc_id, nullif(sha256({form('text')}), sha256('')) AS license_digest, sha256({form('text', True)}) AS whole FROM documents),
x AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\r\\n?|\\n')) AS line FROM documents),
l AS (SELECT doc_id, string_agg(license_id, ',' ORDER BY license_id) AS line_licenses
  FROM (SELECT DISTINCT doc_id, license_id FROM (SELECT doc_id, sha256({form('line')}) AS digest FROM x) JOIN k USING (digest)) GROUP BY 1)
SELECT d.doc_id, license_digest, coalesce(one.license_id, two.license_id) AS license_id, line_licenses
FROM d LEFT JOIN one ON license_digest = one.digest LEFT JOIN one AS two ON whole = two.digest LEFT JOIN l ON l.doc_id = d.doc_id
"""


SQL = _sql()
