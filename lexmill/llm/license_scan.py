"""License scan by diagonal voting, in DataFrame operations only.

Every rolling k-gram of a document's words is joined by hash to the positions where known
license texts have it, and compared word by word (the k-grams themselves are equal). A match
at document position p and template position t votes for the diagonal p - t. Votes are
aggregated by diagonal; diagonals that differ by at most ``slack`` (inserted or left-out
words) merge. A merged span is then verified in order: going through the template, a k-gram counts
only if it stands in the document after all those counted before, and the span is accepted if
these hold at least ``coverage`` of the template's k-grams and take no more than ``stretch`` times
the template's room. Base phrases are templates whose k-grams must all lie on one diagonal, which
is exactly the places where the phrase stands.

Templates are notices of one or two sentences and the whole texts of short licenses. The template
table is the fixed list below, hence broadcast. Only matches and one row per document are
shuffled, by document id and hashes of the text, so that a task that runs again gives the same
rows. Defined cases: null text is empty; a repeated row gives a row each time; null ids
stay null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import name
from .native import words

K = 3
BASE = [("mit", "the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under cc by sa"),
    ("cc-by-nc", "this work is licensed under cc by nc"),
    ("reserved", "no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
]
_WARRANTY = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
#: Whole license texts.
TEMPLATES += [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", f"{_BSD} {_WARRANTY}"),
    ("bsd", f"{_BSD} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_WARRANTY}"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
]


def template_rows(base=BASE, templates=TEMPLATES):
    """(tid, label, base, grams, tpos, gram) of every template k-gram."""
    every = [(label, text, True) for label, text in base] + [(label, text, False) for label, text in templates]
    for tid, (label, text, is_base) in enumerate(every):
        w = text.split()
        for t in range(len(w) - K + 1):
            yield tid, label, is_base, len(w) - K + 1, t, " ".join(w[t : t + K])


_STATE = "struct<t:int,pos:int,first:int,n:int>"


def _in_order(matches: Column) -> Column:
    """Struct (n, first, pos): the k-grams that follow each other in the template and in the document, where the first and the last stand."""
    start = F.struct(*(F.lit(x).cast("int").alias(c) for x, c in ((-1, "t"), (-1, "pos"), (None, "first"), (0, "n"))))

    def step(state, x):
        taken = F.struct(x["t"].alias("t"), x["pos"].alias("pos"), F.coalesce(state["first"], x["pos"]).alias("first"), (state["n"] + 1).alias("n"))
        return F.when((x["t"] > state["t"]) & (x["pos"] > state["pos"]), taken.cast(_STATE)).otherwise(state)

    return F.aggregate(F.array_sort(matches), start, step)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = 0.6, slack: int = 3, stretch: float = 1.5, base=BASE, templates=TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    spark = docs.sparkSession
    rows = list(template_rows(base, templates))
    known = spark.createDataFrame(rows, "tid int, label string, base boolean, grams int, tpos int, gram string")
    known = known.groupBy("gram").agg(F.collect_list(F.struct("tid", "label", "base", "grams", "tpos")).alias("at")).select(F.xxhash64("gram").alias("h"), F.col("gram").alias("known"), "at")
    t = name(text_col).cast("string")
    key = ["doc_id", "k1", "k2", "n"]
    d = docs.select(name(id_col).alias("doc_id"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), t).alias("k2"), words(t).alias("w")).withColumn("n", F.size("w"))
    w = F.col("w")
    grams = F.transform(F.sequence(F.lit(0), F.col("n") - K), lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", *(F.get(w, i + j) for j in range(K))).alias("gram")))
    own = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("gram")))
    d = d.select(*key, F.explode(F.when(F.col("n") >= K, F.concat(own, grams)).otherwise(own)).alias("g")).select(*key, "g.pos", "g.gram").withColumn("h", F.when(F.col("pos") >= 0, F.xxhash64("gram")))
    hit = d.join(F.broadcast(known), "h", "left").where("pos < 0 or gram = known").select(*key, "pos", F.explode_outer("at").alias("t"))
    about = ["tid", "label", "base", "grams"]
    # a document's own row has no template; equal rows count its copies
    votes = hit.select(*key, "t.*", (F.col("pos") - F.col("t.tpos")).alias("diagonal"), "pos").groupBy(*key, *about, "diagonal").agg(F.collect_set(F.struct(F.col("tpos").alias("t"), "pos")).alias("ts"), F.sum(F.when(F.col("pos") < 0, 1).otherwise(0)).alias("copies"))
    by = Window.partitionBy(*key, "tid").orderBy("diagonal")
    new = F.when(F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > slack, F.lit(True)), 1).otherwise(0)
    spans = votes.withColumn("new", new).withColumn("span", F.sum("new").over(by)).groupBy(*key, *about, "span").agg(_in_order(F.flatten(F.collect_list("ts"))).alias("run"), F.sum("copies").alias("copies"))
    spans = spans.select(*key, *about, "copies", F.col("run.n").alias("found"), F.col("run.first").alias("start"), (F.col("run.pos") + K).alias("end"))
    share = F.col("found") / F.col("grams")
    good = F.when(F.col("base"), F.col("found") == F.col("grams")).otherwise((share >= coverage) & (F.col("end") - F.col("start") <= stretch * (F.col("grams") + K - 1)))
    is_base = F.col("base") & good
    text = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    out = spans.groupBy(*key).agg(
        F.sum("copies").alias("copies"), F.coalesce(F.sum(F.when(is_base, 1)), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        text(F.when(is_base, F.col("label"))).alias("base_labels"), text(F.when(good, F.col("label"))).alias("labels"),
        F.coalesce(F.round(F.max(F.when(good, share)), 6), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_set(F.when(good, F.struct("start", "end", "label")))).alias("spans"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", F.col("n").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
