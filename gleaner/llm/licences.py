"""License scans (operator 2): canonical digests of entire texts, looked up among known ones.

A text is brought to a canonical form, after the published guidelines for matching licences: A-Z lower-cased; copyright
lines, "all rights reserved" and list markers dropped; "&" read as "and"; punctuation and white space made word gaps; equivalent
spellings, of one word or several, made one. A title over a known text may be there or not. The SHA-256 of the form is joined to the digests of
known licences, whose texts went through the same expressions. Units are the whole document, and each of
its lines that holds a cue, so a notice line at the end of a page is found too. A cue is a piece of one word that no
equivalent spelling brings in or takes out, so a line holds it if and only if its canonical form does; every known text
holds one, which is checked.

The known table is this module's own (common licences whole, and one-line notices; a few dozen rows) or one that the
caller gives; its size is Spark's to judge. Documents send only ids and digests through the join.

Nulls are empty texts, which have no licence; a text of any length is one row. Two known texts with one form: both are
reported, in order of name. A line repeated in a document counts each time. Rows that share an id and a text, or have no id and
the same text, each get what one of them would get; rows that share an id only are looked up each on its own. An empty table gives
an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, UPPER

#: Published licence texts and notices, without their copyright lines.
KNOWN = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-0": "MIT No Attribution License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT notice": "Released under the MIT License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org/>",
    "Unlicense notice": "This is free and unencumbered software released into the public domain.",
    "Zlib": "zlib License\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
}
#: Longer published licence texts, one file each, named by the licence.
KNOWN |= {f.stem: f.read_text("utf-8") for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
#: Spellings that licence matching takes as one.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize",
    "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "wilfull",
    "copyright owner": "copyright holder", "copyright owners": "copyright holders", "https": "http", "non commercial": "noncommercial", "non infringement": "noninfringement", "per cent": "percent",
    "sub license": "sublicense", "sub licensed": "sublicensed", "sub licenses": "sublicenses", "sub licensing": "sublicensing",
}
#: Pieces of words, in letters only.
CUES = ("licen", "permission", "redistribution", "public")
#: What follows "copyright" in the text of a licence; in a copyright line it is a year, a sign or a name.
FOLLOWERS = "notice holder owner license licence law statement interest disclaimer and or in for to is on as of under right permission treaty protection act work claim".split()
_START = r"^[^\p{L}\p{N}\n(©]*"
#: What is dropped from a text in lower case: copyright lines (with or without a year), the phrase, list markers.
DROPPED = (
    _START + r"(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|by )|\(c\)[ \t]*[0-9]{4}|©|copyright(?:[,:][ \t]*|[ \t]+)NAME)[^\n]*$",
    r"all rights reserved",
    r"^[ \t]*(?:\(?(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})[.)]|[*•-])[ \t]+",
)
GAPS = r"[^\p{L}\p{N}]+"
_FOLLOWERS = "(?:" + "|".join(FOLLOWERS) + r")(?:s|es)?\b"
#: A name is a word that doesn't follow "copyright" in a licence.
_DROPPED = "|".join(DROPPED).replace("NAME", f"(?!{_FOLLOWERS})" + r"[\p{L}\p{N}]")


def _lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _spelt(words: str) -> str:
    """Words as the form has them: a space on each side, so two between words."""
    return " " + "  ".join(words.split()) + " "


def canonical(text: Column) -> Column:
    """Words with a space on each side, two between words, so that whole words can be replaced."""
    kept = F.regexp_replace(F.replace(_lower(text), F.lit("&"), F.lit(" and ")), "(?md)" + _DROPPED, " ")  # d: only \\n ends a line
    form = F.concat(F.lit(" "), F.trim(F.regexp_replace(kept, GAPS, "  ")), F.lit(" "))
    for one, other in SPELLINGS.items():
        form = F.replace(form, F.lit(_spelt(one)), F.lit(_spelt(other)))
    return form


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def variants(texts: dict[str, str]) -> list[tuple[str, str]]:
    """(licence, text): each text, and without its title where it has one (a short first paragraph that isn't a sentence)."""
    out = []
    for name, text in texts.items():
        out.append((name, text))
        title, _, rest = text.strip().partition("\n\n")
        if rest.strip() and len(title.split()) <= 12 and not title.rstrip().endswith((".", ":")):
            out.append((name, rest))
    return out


def known_licences(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(licence, text)."""
    return spark.createDataFrame(variants(KNOWN if texts is None else texts), "licence string, text string")


def scan(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cues: tuple[str, ...] = CUES) -> DataFrame:
    """One row a document: (id, digest, licence of the whole text or null, n_notices, notices): the lines that
    are known texts, how many and which (sorted, joined by "; ")."""
    if odd := [c for c in cues if not c.isalpha()]:
        raise ValueError(f"cues that aren't pieces of one word: {odd}")
    if missed := known.filter(~_cued(canonical(F.col("text")), cues)).select("licence").take(5):
        raise ValueError(f"known texts without a cue word: {[r[0] for r in missed]}")
    names = known.select(digest(F.col("text")).alias("digest"), "licence").groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("licence")), "; ").alias("licence"))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    whole = own.select("id", digest(F.col("text")).alias("digest")).join(names, "digest", "left")
    # A line counts by its place, so copies of a row don't add up.
    lines = own.filter(_cued(F.col("text"), cues)).select("id", digest(F.col("text")).alias("whole"), F.posexplode(F.split("text", "\n")).alias("place", "line")).filter(_cued(F.col("line"), cues))
    found = lines.select("id", "whole", "place", digest(F.col("line")).alias("digest")).join(names, "digest").groupBy("id", "whole").agg(F.count_distinct("place").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("licence")), "; ").alias("notices")).withColumnRenamed("id", "of")
    return whole.join(found, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("whole")), "left").select(F.col("id").alias(id_col), "digest", "licence", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def _cued(text: Column, cues: tuple[str, ...]) -> Column:
    low = _lower(text)
    found = F.lit(False)
    for cue in cues:
        found = found | low.contains(cue)
    return found


def scan_sql(known: dict[str, str] | None = None) -> str:
    """The same in DuckDB's SQL, for documents(doc_id, text); every line is looked up."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    low = f"replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '&', ' and ')"
    # No lookahead there: what isn't a copyright line is marked before copyright lines are dropped.
    marked = f"regexp_replace({low}, {quote('(?m)(' + _START + ')copyright((?:[,:][ \\t]*|[ \\t]+)' + _FOLLOWERS + ')')}, {quote('\\1copyri_ht\\2')}, 'g')"
    dropped = "|".join(DROPPED).replace("NAME", r"[\p{L}\p{N}]")
    kept = f"replace(regexp_replace({marked}, {quote('(?m)' + dropped)}, ' ', 'g'), 'copyri_ht', 'copyright')"
    form = f"' ' || trim(regexp_replace({kept}, {quote(GAPS)}, '  ', 'g')) || ' '"
    for one, other in SPELLINGS.items():
        form = f"replace({form}, '{_spelt(one)}', '{_spelt(other)}')"
    rows = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in variants(KNOWN if known is None else known))
    return f"""
WITH known(licence, text) AS (VALUES {rows}),
names AS (SELECT sha256({form}) AS digest, string_agg(DISTINCT licence, '; ' ORDER BY licence) AS licence FROM known GROUP BY 1),
whole AS (SELECT doc_id, sha256({form}) AS digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents),
found AS (SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT licence, '; ' ORDER BY licence) AS notices FROM (SELECT doc_id, sha256({form}) AS digest FROM lines) JOIN names USING (digest) GROUP BY 1)
SELECT doc_id, digest, licence, coalesce(n_notices, 0)::BIGINT AS n_notices, coalesce(notices, '') AS notices
FROM whole LEFT JOIN names USING (digest) LEFT JOIN found USING (doc_id)
"""
