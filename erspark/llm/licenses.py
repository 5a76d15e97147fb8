"""License scans by canonical digests of entire texts, with DataFrame functions only.

A text is normalised (case, punctuation, copyright lines, equivalent spellings, white
space), and the SHA-256 of all of it is hash-joined to the digests of known licences, a
fixed table of short texts and of the digests of long ones. ``notices`` does the same for
each line, for one-line licence notices.

Null and empty texts, and texts of copyright lines or punctuation alone, match nothing.
Repeated rows are answered one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import literal_rows

# Public licence texts without their copyright lines, which are dropped anyway.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_TERMS = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
TEXTS = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", f"{_ISC_TERMS}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("ISC", f"ISC License\n\n{_ISC_TERMS}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC_TERMS}.\n\n{_ISC_WARRANTY}"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_WARRANTY),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]
# Digests, as ``digest`` gives them, of longer public licence texts; "to end" and
# "before end" are the texts up to the line END OF TERMS AND CONDITIONS, with it and without it.
DIGESTS = [
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),  # Apache-2.0 to end
    ("Apache-2.0", "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64"),  # Apache-2.0 before end
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),  # Artistic
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),  # BSD
    ("CC0-1.0", "de4b88a2c819a4661af54f735069ed878216da8b4992b919b84afa18cfc0e54c"),  # CC0-1.0
    ("GFDL-1.2-only", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),  # GFDL-1.2
    ("GFDL-1.3-only", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),  # GFDL-1.3
    ("GPL-1.0-only", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),  # GPL-1
    ("GPL-1.0-only", "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b"),  # GPL-1 to end
    ("GPL-1.0-only", "af30c0af27b90ec812acdb040f3dcc944a87cd893456690efe35063f39e3eeeb"),  # GPL-1 before end
    ("GPL-2.0-only", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),  # GPL-2
    ("GPL-2.0-only", "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca"),  # GPL-2 to end
    ("GPL-2.0-only", "c67cc53030ae25fe2e2f0143b59060eca5ad89da8d2beca1445641234d29fc88"),  # GPL-2 before end
    ("GPL-3.0-only", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),  # GPL-3
    ("GPL-3.0-only", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),  # GPL-3 to end
    ("GPL-3.0-only", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),  # GPL-3 before end
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),  # LGPL-2
    ("LGPL-2.0-only", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),  # LGPL-2 to end
    ("LGPL-2.0-only", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),  # LGPL-2 before end
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),  # LGPL-2.1
    ("LGPL-2.1-only", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),  # LGPL-2.1 to end
    ("LGPL-2.1-only", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),  # LGPL-2.1 before end
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),  # LGPL-3
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),  # MPL-1.1
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),  # MPL-2.0
]
# Spellings that count as the same word.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization",
    "whilst": "while", "wilful": "willful", "https": "http", "noncommercial": "non commercial", "sublicence": "sublicense",
    "sub-licence": "sublicense", "sub-license": "sublicense", "owner": "holder", "owners": "holders",
}

#: Comment marks that may stand before a line, then a copyright statement with a year, a name or a mark.
COPYRIGHT = r"(?m)^[ \t#*/;-]*(copyright[ \t]+(\([cC]\)|©|[0-9<\[]|by[ \t])|\([cC]\)[ \t]*[0-9]|©|all rights reserved)[^\n]*$"
PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F ©«»‐-‧‰-⁞]+"


def normalise(text):
    """Words of the canonical text, joined by one space."""
    low = F.lower(text)
    joined = F.regexp_replace(low, r"sub-licen[cs]e", "sublicense")
    bare = F.regexp_replace(joined, COPYRIGHT, " ")
    words = F.filter(F.split(F.regexp_replace(bare, PUNCTUATION, " "), " "), lambda w: w != "")
    table = F.create_map(*[F.lit(x) for kv in sorted(SPELLINGS.items()) for x in kv])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w)), " ")


def digest(text):
    """SHA-256 of the canonical text; null where nothing is left."""
    canonical = normalise(F.coalesce(text, F.lit("")))
    return F.when(canonical != "", F.sha2(canonical, 256))


def known(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license) of the given texts, or of all known ones; one name where texts meet."""
    rows = literal_rows(spark, [{"license": n, "text": t} for n, t in texts or TEXTS], "license: string, text: string")
    table = rows.select(digest(F.col("text")).alias("digest"), "license").filter("digest is not null")
    if texts is None:
        table = table.unionByName(literal_rows(spark, [{"digest": d, "license": n} for n, d in DIGESTS], "digest: string, license: string"))
    return table.groupBy("digest").agg(F.min("license").alias("license"))


def needed_words(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> list[str]:
    """A few words of which every known text has one, each as it must stand in any equal text.

    No word that an equivalent spelling could stand for is taken, so a text without
    any of them cannot have a known digest.
    """
    rows = literal_rows(spark, [{"text": t} for _, t in texts or TEXTS], "text: string").select(normalise(F.col("text")).alias("c")).collect()
    altered = {*SPELLINGS, "sublicense", *(w for v in SPELLINGS.values() for w in v.split())}
    open_ = [set(r["c"].split()) - altered for r in rows if r["c"]]
    open_ = [{w for w in x if len(w) >= 8} or x for x in open_]  # long words are rare in other texts
    out: list[str] = []
    while open_:
        best = max({w for x in open_ for w in x}, key=lambda w: (sum(w in x for x in open_), len(w), w), default="")
        out.append(best)  # the empty word is in every text: then all are looked at
        open_ = [x for x in open_ if best and best not in x] if best else []
    return out


def scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, digest, license of entire texts (null if unknown)."""
    found = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    return found.join(F.broadcast(known(docs.sparkSession, texts)), "digest", "left").select("doc_id", "digest", "license")


def scan_with_notices(docs: DataFrame, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, digest, license of the entire text, n_notices and notices of its lines.

    notices: sorted names of the given texts (``TEXTS``) that a line is on its own. Lines look
    their digests up in the fixed table in place, so no document's lines are gathered.
    """
    table = known(docs.sparkSession, texts)
    short = known(docs.sparkSession, texts or TEXTS)  # texts of which needed_words knows the words
    names = F.create_map(*[F.lit(x) for r in sorted(short.collect()) for x in r])  # the fixed table, a few rows
    words = F.array(*[F.lit(w) for w in needed_words(docs.sparkSession, texts)])
    may = lambda x: F.exists(words, lambda w: F.contains(F.lower(x), w))
    found = F.coalesce(F.transform(F.split("text", "\n"), lambda x: F.when(may(x), F.element_at(names, digest(x)))), F.array().cast("array<string>"))
    hits = docs.select("doc_id", digest(F.col("text")).alias("digest"), F.filter(found, lambda x: x.isNotNull()).alias("hits"))
    whole = hits.join(F.broadcast(table), "digest", "left")
    return whole.select("doc_id", "digest", "license", F.size("hits").cast("bigint").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notices"))
