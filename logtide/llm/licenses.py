"""License scans by canonical digest, in DataFrame functions only.

A text is brought into canonical form (lower case, copyright notices dropped, equivalent spellings made one,
punctuation and white space reduced to single spaces) and hashed whole.  Licenses are matched by the digest of a bare form, in which
title lines and lines of reserved rights are dropped too, spellings are made one across line ends, single letters and numbers of one or two digits (list marks) go,
the names that some licenses leave open are made one, and a head of at most ``HEAD`` words before a license's first words (a project's name, a wrapped notice) is cut;
it is joined with those of known licenses.  A license that has a marked end is known with and without what follows the mark.

The bare form is made only of texts that hold one of a few long words, chosen so that every known license holds one: others cannot be equal to any.

Cases:  a null text has a null digest and no license; a text without letters or digits has the digest of the empty
text and no license; copies of a license under several ids report the least id; repeated rows are rows of their own; a very long text is one value of each step, as
Spark holds it; no documents or no known licenses give no row or no license; other columns are ignored.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

# Pairs of spellings that license matching treats as equal.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("fulfil ", "fulfill "),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"),
    ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"),
    ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"),
    ("sub license", "sublicense"), ("sub-license", "sublicense"), ("non commercial", "noncommercial"), ("non-commercial", "noncommercial"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https://", "http://"),
]
_MARGIN = r"(?md)^[ \t*#/;>-]*+"
_NO_NOTICE = r"notices?|holders?|owners?|laws?|licen[sc]es?|interests?|statements?|permissions?|protections?|treat(?:y|ies)|disclaimers?|rights?|status|conditions|and|or|in|on|to|of|is|as|for|which|that|with"
NOTICE = _MARGIN + rf"(?:copyright\b(?![ \t]*$)(?![ \t,]+(?:{_NO_NOTICE})\b)|©|\(c\)[ \t]*(?:(?=[^\n]*(?:copyright|\b(?:19|20)\d\d\b))|(?=(?:[^ \t\n]+[ \t]*){{0,4}}$)))[^\n]*$"
"""A notice; wrapped text such as "copyright notice and this ..." and list items such as "(c) you must ..." are none."""
_FAMILY = r"(?:mit(?:-0)?|expat|x11|isc|0?bsd|zlib|libpng)"
_TITLE_WORDS = r"(?:[ \t\"':(),/._=*-]|\b(?:" + _FAMILY + r"|spdx|identifier|the|software|licen[sc]e|free|zero|two|three|[0-3]|clause|simplified|freebsd|net|new|revised|modified|original|no|attribution|or|style)\b){1,80}$"
TITLE = _MARGIN + r"(?=[^\n]*\b" + _FAMILY + r"\b)" + _TITLE_WORDS
_RIGHTS = r"all rights (?:are )?reserved[.!]?[ \t*#/;-]*$"
RIGHTS = _MARGIN + _RIGHTS
APART = r"[^\p{L}\p{N}]+"


def _without_notices(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text.cast("string")), r"\r\n?", "\n"), NOTICE, " ")


def spelled(text: Column) -> Column:
    """Lower case, notices dropped, equivalent spellings made one: what both forms begin with."""
    out = _without_notices(text)
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(one), F.lit(other))
    return out


def _plain(out: Column) -> Column:
    return F.regexp_replace(out, APART, " ")


HEAD, START, ANCHOR = 40, 5, 8
"""Words that may stand before a license's first words, how many those are, and the letters of a word that texts are met by."""
MOST_KNOWN = 5_000
"""Rows of the table of known licenses, whose first words and long words reach the driver."""
END_MARK = "end of terms and conditions"
# Places where licenses leave a name open, as (expression, plain form).
OPEN_NAMES = [
    (r" neither the names? of (?:[^ ]+ ){1,12}?nor the names? of ", " neither the name of the copyright holder nor the names of "),
    (r" software is provided by (?:[^ ]+ ){1,12}?as is ", " software is provided by the copyright holders and contributors as is "),
    (r" in no event shall (?:[^ ]+ ){1,12}?be liable ", " in no event shall the copyright holder be liable "),
    (r" (?:[0-9]{1,2}|[a-z])(?: (?:[0-9]{1,2}|[a-z]))* ", " "),
]


def _unheaded(out: Column) -> Column:
    """The bare form of a spelled text, with its head."""
    out = F.concat(F.lit(" "), _plain(F.regexp_replace(F.regexp_replace(out, TITLE, " "), RIGHTS, " ")), F.lit(" "))
    for one, other in SPELLINGS:
        if " " in one:  # spellings of two words, which a line end or a mark may have parted
            out = F.replace(out, F.lit(one), F.lit(other))
    out = F.concat(F.lit(" "), F.trim(out), F.lit(" "))
    for found, plain in OPEN_NAMES:
        out = F.regexp_replace(out, found, plain)
    return F.ltrim(out)


def _headless(starts: list[str]) -> str:
    return rf"^(?:[^ ]+ ){{0,{HEAD}}}((?:{'|'.join(starts)}) )"


def _bare(out: Column, starts: list[str]) -> Column:
    return F.trim(F.regexp_replace(_unheaded(out), _headless(starts), "$1") if starts else _unheaded(out))


def canonical(text: Column) -> Column:
    return F.trim(_plain(spelled(text)))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the built-in texts; a larger table of the same columns can take its place."""
    return spark.createDataFrame(list(LICENSES.items()), "license_id string, text string")


def _variants(known: DataFrame) -> DataFrame:
    """(license_id, _s): spelled texts, and those that end at or before the mark of the end."""
    rows = known.select("license_id", spelled(F.col("text")).alias("_s"))
    at = F.instr("_s", END_MARK)
    cuts = F.array(F.col("_s"), F.when(at > 0, F.substring(F.col("_s"), F.lit(1), at - 1)), F.when(at > 0, F.substring(F.col("_s"), F.lit(1), at - 1 + len(END_MARK))))
    return rows.select("license_id", F.explode(F.filter(cuts, lambda c: c.isNotNull())).alias("_s"))


def met_by(texts: list[str]) -> tuple[list[str], list[str]]:
    """The first words of bare texts, and long words of which each text holds one (none, if some text has no such word)."""
    starts = sorted({" ".join(t.split(" ")[:START]) for t in texts})
    changed = {w for pair in [*SPELLINGS, *OPEN_NAMES] for side in pair for w in side.replace("-", " ").split(" ")}
    words = [{w for w in t.split(" ") if len(w) >= ANCHOR and w.isalpha() and w.isascii()} - changed for t in texts]
    anchors, left = [], list(range(len(texts)))
    while left:
        counts: dict[str, int] = {}
        for i in left:
            for w in words[i]:
                counts[w] = counts.get(w, 0) + 1
        if not counts:
            return starts, []
        anchors.append(min(counts, key=lambda w: (-counts[w], w)))
        left = [i for i in left if anchors[-1] not in words[i]]
    return starts, anchors


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): doc_id, canonical_sha256, license_id (null: none).  ``known`` has at most ``MOST_KNOWN`` rows."""
    texts = [r[0] for r in _variants(known).select(F.trim(_unheaded(F.col("_s")))).limit(3 * MOST_KNOWN + 1).collect() if r[0]]
    if len(texts) > 3 * MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known licenses")
    starts, anchors = met_by(texts)
    table = _variants(known).select("license_id", _bare(F.col("_s"), starts).alias("_c")).where(F.length("_c") > 0).select("license_id", F.sha2("_c", 256).alias("_bare"))
    table = table.groupBy("_bare").agg(F.min("license_id").alias("license_id"))
    # A projection of its own: both forms read it, so the spellings are replaced once.
    rows = docs.select("doc_id", spelled(F.col("text")).alias("_s"))
    likely = F.lit(not anchors)
    for word in anchors:
        likely = likely | F.contains(F.col("_s"), F.lit(word))
    rows = rows.select("doc_id", F.sha2(F.trim(_plain(F.col("_s"))), 256).alias("canonical_sha256"), F.when(likely, F.sha2(_bare(F.col("_s"), starts), 256)).alias("_bare"))
    return rows.join(table, "_bare", "left").select("doc_id", "canonical_sha256", "license_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), known_licenses(spark))


def oracle() -> str:
    """The query's rule in SQL, which has no look-around: notices and titles are sought line by line."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rule = lambda yes, no=(): "(" + " AND ".join([*(f"regexp_matches(x, {quote(y)})" for y in yes), *(f"NOT regexp_matches(x, {quote(n)})" for n in no)]) + ")"
    margin = r"^[ \t*#/;>-]*"
    notice = " OR ".join([
        rule([margin + r"copyright\b"], [margin + rf"copyright(?:[ \t]*$|[ \t,]+(?:{_NO_NOTICE})\b)"]), rule([margin + "©"]),
        rule([margin + r"\(c\).*(?:copyright|\b(?:19|20)[0-9][0-9]\b)"]), rule([margin + r"\(c\)[ \t]*(?:[^ \t]+[ \t]*){0,4}$"]),
    ])
    title = rule([rf"\b{_FAMILY}\b", margin + _TITLE_WORDS]) + " OR " + rule([margin + _RIGHTS])
    dropped = lambda text, lines: f"array_to_string(list_filter(string_split({text}, chr(10)), lambda x: NOT ({lines})), chr(10))"

    def replaced(out: str, pairs: list) -> str:
        for one, other in pairs:
            out = f"replace({out}, {quote(one)}, {quote(other)})"
        return out

    def sub(out: str, pairs: list) -> str:
        for one, other in pairs:
            out = f"regexp_replace({out}, {quote(one)}, {quote(other)}, 'g')"
        return out

    said = replaced(dropped(r"regexp_replace(lower(text), '\r\n?', chr(10), 'g')", notice), SPELLINGS)
    plain = lambda out: f"regexp_replace({out}, {quote(APART)}, ' ', 'g')"
    two = [p for p in SPELLINGS if " " in p[0]]
    bare = "ltrim(" + sub("' ' || trim(" + replaced(f"' ' || {plain(dropped('s', title))} || ' '", two) + ") || ' '", OPEN_NAMES) + ")"
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in LICENSES.items())
    return f"""
    WITH k(license_id, text) AS (VALUES {known}),
    v AS (SELECT license_id, {said} AS s FROM k),
    w AS (SELECT license_id, s FROM v UNION ALL SELECT license_id, s[1:instr(s, '{END_MARK}') - 1] FROM v WHERE instr(s, '{END_MARK}') > 0
      UNION ALL SELECT license_id, s[1:instr(s, '{END_MARK}') - 1 + {len(END_MARK)}] FROM v WHERE instr(s, '{END_MARK}') > 0),
    b AS (SELECT license_id, {bare} AS c FROM w),
    h AS (SELECT '^(?:[^ ]+ ){{0,{HEAD}}}((?:' || (SELECT string_agg(DISTINCT array_to_string(string_split(trim(c), ' ')[1:{START}], ' '), '|') FROM b WHERE trim(c) <> '') || ') )' AS head),
    t AS (SELECT sha256(trim(regexp_replace(c, head, '\\1'))) AS bare, min(license_id) AS license_id FROM b, h WHERE trim(c) <> '' GROUP BY 1),
    d AS (SELECT doc_id, {said} AS s FROM documents),
    e AS (SELECT doc_id, s, {bare} AS c FROM d)
    SELECT doc_id, sha256(trim({plain('s')})) AS canonical_sha256, license_id FROM e CROSS JOIN h LEFT JOIN t ON t.bare = sha256(trim(regexp_replace(c, head, '\\1')))
    """


# The texts of short licenses; the folder ``texts`` has long ones.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
SHORT = {
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC_WARRANTY}",
    "BSD-2-Clause": f"{_BSD_HEAD}\n\n{_BSD_WARRANTY}",
    "BSD-3-Clause": f"{_BSD_HEAD}\n{_BSD_THIRD}\n\n{_BSD_WARRANTY}",
    "ISC": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}",
    "MIT": f"{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_WARRANTY}",
    "MIT-0": f"{_MIT_GRANT}.\n\n{_WARRANTY}",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
LICENSES = SHORT | {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted((files(__package__) / "texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
