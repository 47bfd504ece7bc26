"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, and against brute force."""

import hashlib
import itertools
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from folionaut.llm import op1_license, op2_mix, op3_tokens, op4_sentencepiece, op5_chat, op6_exact, op7_urls, op8_ann, op9_neardup, op10_toxicity
from folionaut.llm.components import components
from folionaut.llm.pieces import Vocabulary, codes_of, segment, viterbi

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, n int"
LONG = "lorem ipsum dolor " * 20_000


BIG = 2**53 + 1  # a float can't hold it


def docs(spark, texts, sources=None, ids=None):
    """Extra columns have names that operators use inside."""
    rows = [(i if ids is None else ids[i], t, "en", sources[i] if sources else "s", 0, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


ODD = [None, "", "   \n\t", LONG, "same text", "same text", "é" * 50, "日本語 テスト"]


def test_license(spark):
    texts = [*ODD, "a b.\nLicensed under the Apache License, Version 2.0.", "LICENSED under the APACHE license version 2.0. And more", "Not licensed under anything", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The software is provided \"as is\", without warranty of any kind"]
    got = {r.doc_id: (r.licence, r.sentence_ids, r.n_hits) for r in op1_license.license_scan(docs(spark, texts)).collect()}
    assert all(got[i] == (None, "", 0) for i in range(8)) and got[8] == got[9] == ("apache-2.0", "A", 1)
    assert got[10][0] is None and got[11] == ("mit", "P,V", 2)
    assert op1_license.license_scan(docs(spark, [])).count() == 0


APACHE = """Copyright 2020 A. Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """Copyright (c) 2020 A. Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD2 = """Copyright (c) 2020, A. Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
REST = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""


def test_license_headers(spark):
    """Unabridged texts, as they are, as comments, with other line ends and wrapped at any width."""
    inc = BSD3.replace("the copyright holder nor", "A. Body\nInc. nor").replace("3. ", "3) ") + REST
    lgpl = GPL.replace("This program is free", "The body library is free").replace("GNU General", "GNU Lesser General")
    want = [(APACHE, "apache-2.0", "A,B,C"), (MIT, "mit", "P,Q,V"), (BSD2 + REST, "bsd-2-clause", "R,D"), (BSD3 + REST, "bsd-3-clause", "R,D,E"), (inc, "bsd-3-clause", "R,D,E"), (GPL, "gpl-3.0", "H"), (lgpl, "lgpl", "L")]
    want += [(GPL.replace("version 3", "version 2"), "gpl-2.0", "g"), (GPL.replace("GNU General", "GNU Affero General"), "agpl-3.0", "a"), (GPL.replace("version 3", "version 1"), None, ""), ("(c) A. Body. All\nrights reserved", "proprietary", "R"), ("Not\n" + MIT.split("\n\n")[1].replace("\n", " ", 1).replace("Permission", "is permission", 1), None, "")]
    want += [("This work is licensed under a Creative Commons Attribution-NonCommercial\n4.0 International License.", "cc-by-nc-4.0", "N")]
    forms = [lambda t: t, lambda t: re.sub("(?m)^", " * ", t), lambda t: re.sub("(?m)^", "// ", t), lambda t: t.replace("\n", "\r\n"), lambda t: "Some code\n" + t + "\nmore code"]
    forms += [lambda t, w=w: "\n\n".join(p if p.startswith("Copyright") else textwrap.fill(p, w) for p in t.split("\n\n")) for w in (30, 47, 80, 9999)]
    cases = [(f(t), name, ids) for t, name, ids in want for f in forms]
    got = {r.doc_id: (r.licence, r.sentence_ids) for r in op1_license.license_scan(docs(spark, [t for t, _, _ in cases])).collect()}
    assert [(k, got[k], cases[k][0]) for k in got if got[k] != cases[k][1:]] == []


def test_more_licenses(spark):
    isc = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted"""
    zlib_ = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
    cases = {
        isc + ", provided that the above\ncopyright notice and this permission notice appear in all copies.": "isc", isc + ".": "0bsd", zlib_: "zlib",
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.": "mpl-2.0",
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy": "unlicense",
        "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)": "bsl-1.0",
        "To the extent possible under law, the author(s) have dedicated all copyright and\nrelated and neighboring rights to this software to the public domain\nworldwide. This software": "cc0-1.0",
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.\nThis license is copied below": "ofl-1.1",
        'Licensed under the EUPL, Version 1.2 or – as soon they will be approved by\nthe European Commission - subsequent versions of the EUPL (the "Licence");': "eupl-1.2",
        'The contents of this file are subject to the terms of the Common Development\nand Distribution License (the "License").  You may not use': "cddl-1.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-\nShareAlike 4.0 International License.": "cc-by-nc-sa-4.0",
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": "cc-by-3.0",
        MIT.replace("THE SOFTWARE IS", "The Software shall be used for Good, not Evil.\n\nTHE SOFTWARE IS"): "json",
        BSD3.replace("3. Neither", "3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement:\n   This product includes software.\n\n4. Neither") + REST: "bsd-4-clause",
        "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/": "epl-2.0",
        "You can use this software according to the terms and conditions of the Mulan PSL v2.": "mulan-psl-2.0",
        "He said the Mozilla Public License, v. 2.0 was fine.": None,
    }
    got = {r.doc_id: r.licence for r in op1_license.license_scan(docs(spark, list(cases))).collect()}
    assert [(t, got[i], want) for i, (t, want) in enumerate(cases.items()) if got[i] != want] == []


def test_targets_never_exceed_caps():
    rng = random.Random(1)
    for _ in range(200):
        sizes = {k: rng.choice([0, 0, 5, rng.randrange(1, 1000)]) for k in range(rng.randrange(1, 8))}
        weights = {k: rng.randrange(1, 4) for k in sizes}
        got = op2_mix.targets(sizes, sum(sizes.values()), weights, 3.0)
        assert all(got[k] <= 3 * sizes[k] + 1e-9 for k in sizes) and abs(sum(got.values()) - sum(sizes.values())) < 1e-6
        free = [got[k] / weights[k] for k in sizes if got[k] < 3 * sizes[k] - 1e-9]
        assert not free or max(free) - min(free) < 1e-6


def test_flow_is_cheapest():
    # The pattern of both sources must leave its words to the source that has nothing else.
    flows = op2_mix.min_cost_flow({("a",): 100, ("a", "b"): 50, ("c",): 7}, {"a": 100, "b": 50, "c": 20}, 3)
    assert flows == {("a",): {"a": 100}, ("a", "b"): {"b": 50}, ("c",): {"c": 20}}
    repeated = op2_mix.min_cost_flow({("a",): 10, ("a", "b"): 10}, {"a": 30, "b": 10}, 3)
    assert sum(repeated[("a",)].values()) == sum(repeated[("a", "b")].values()) == 20  # convex costs even repetitions out


def test_mix(spark):
    rng = random.Random(2)
    texts = [None, "", *(words(rng, rng.choice([1, 3, 50, 400])) for _ in range(300))]
    src = [None, "z", *(rng.choice(["a", "a", "a", "b", None]) for _ in range(300))]
    mixed = op2_mix.mix(docs(spark, texts, src), F.array("source"))
    rows = mixed.select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_taken").collect()
    assert sorted(r.doc_id for r in rows) == list(range(302))
    assert all(r.mix_size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")) and 0 <= r.mix_taken <= 3 * r.mix_size for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.mix_taken for r in own) - own[0].mix_target) <= 1 and own[0].mix_source_size == sum(r.mix_size for r in own)
    again = op2_mix.mix(docs(spark, texts, src).repartition(7), F.array("source"))
    assert {r.doc_id: r.mix_taken for r in again.collect()} == {r.doc_id: r.mix_taken for r in rows}
    assert op2_mix.mix(docs(spark, []), F.array("source")).count() == 0


def cheapest_brute(patterns, quotas, repeats):
    """(most words, least cost) over all ways to send whole words from patterns to their sources."""
    best = (0, 0)
    routes = [(p, s) for p in patterns for s in p]
    for sent in itertools.product(*(range(min(quotas[s], repeats * patterns[p]) + 1) for p, s in routes)):
        flow = {p: sum(x for (q, _), x in zip(routes, sent) if q == p) for p in patterns}
        if all(flow[p] <= repeats * patterns[p] for p in patterns) and all(sum(x for (_, t), x in zip(routes, sent) if t == s) <= quotas[s] for s in quotas):
            best = max(best, (sum(sent), -sum(cost_of(flow[p], patterns[p], repeats) for p in patterns)))
    return best


def cost_of(words, size, repeats):
    return sum(k * k * max(0, min(size, words - k * size)) for k in range(repeats))


def test_flow_against_brute_force():
    rng = random.Random(21)
    sent = 0
    for _ in range(150):
        names = "ab"[: rng.randrange(1, 3)]
        patterns = {p: rng.randrange(0, 4) for p in rng.sample([("a",), ("b",), ("a", "b")] if len(names) == 2 else [("a",)], rng.randrange(1, 1 + (3 if len(names) == 2 else 1)))}
        quotas = {s: rng.randrange(0, 7) for p in patterns for s in p}
        solver = op2_mix.Flow(patterns, quotas)
        flows = solver.solve(3)
        total = {p: sum(flows[p].values()) for p in patterns}
        got = (sum(total.values()), -sum(cost_of(total[p], patterns[p], 3) for p in patterns))
        assert got == cheapest_brute(patterns, quotas, 3), (patterns, quotas, flows)
        assert solver.augmentations > 0 or got[0] == 0
        sent += solver.augmentations
    assert sent > 150


def test_mix_sends_words_through_the_flow(spark, monkeypatch):
    """Also where a document has one source: passes come from arcs of repetitions."""
    calls = []
    plain = op2_mix.Flow.solve

    def counted(self, repeats, **more):
        out = plain(self, repeats, **more)
        calls.append((self.augmentations, repeats))
        return out

    monkeypatch.setattr(op2_mix.Flow, "solve", counted)
    solve = op2_mix._solved({"a": 25, "b": 0}, 3)
    import pandas as pd

    frames = list(solve(iter([pd.DataFrame({"component": [0, 1], "mix_pattern": [["a"], ["b"]], "mix_words": [10, 5]})])))
    assert [f.mix_flow.tolist() for f in frames] == [[25], [0]] and calls == [(3, 3), (0, 3)]


def test_mix_odd_rows(spark):
    """Null and repeated doc_ids, columns named like the result's, sources that form chains."""
    texts = ["w " * 10] * 40 + ["x " * 7] * 10
    ids = [None] * 40 + [5] * 10
    df = docs(spark, texts, ["a"] * 25 + ["b"] * 25, ids).withColumn("mix_taken", F.lit("mine")).withColumn("mix_extra", F.lit(1))
    got = op2_mix.mix(df, F.array("source"), share=0.5)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "n", "mix_size", "mix_source_size", "mix_target", "mix_taken"]
    rows = got.collect()
    assert len(rows) == 50
    for s in ("a", "b"):
        own = [r for r in rows if r.source == s]
        assert own[0].mix_target - 50 < sum(r.mix_taken for r in own) <= own[0].mix_target + 1
    chain = spark.createDataFrame([(i, "w " * 10, [f"s{i % 5}", f"s{i % 5 + 1}"]) for i in range(60)], "doc_id long, text string, tags array<string>")
    taken = op2_mix.mix(chain, F.col("tags"), weights=lambda i, s: 1).agg(F.sum("mix_taken")).first()[0]
    assert taken == 600


def test_mix_overlapping(spark):
    rows = spark.createDataFrame([(i, "w " * 10, ["a"] if i % 2 else ["b", "a", "a"]) for i in range(100)], "doc_id long, text string, tags array<string>")
    got = op2_mix.mix(rows, F.col("tags")).agg(F.sum("mix_taken")).first()[0]
    assert got == 1000


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary.load(op4_sentencepiece.MODEL)


def test_encoding_equals_the_library(spark, vocab):
    rng = random.Random(3)
    texts = [*ODD, " a  b", "a\n\nb\tc", "▁x", "a" * 3000, "<0x0A> <s> </s>", "𝔘𝔫𝔦", *("".join(rng.choice("abcdehilnorst  .,\n") for _ in range(80)) for _ in range(60))]
    encoded = op4_sentencepiece.encode(docs(spark, texts))
    got = {r.doc_id: r for r in encoded.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=op4_sentencepiece.MODEL)
    for i, t in enumerate(texts):
        assert got[i].ids == library.encode(t or "") and got[i].n_ids == len(got[i].ids) and got[i].round_trip
    back = {r.doc_id: r.text for r in op4_sentencepiece.decoded(encoded).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    assert op4_sentencepiece.encode(docs(spark, [])).count() == 0


def plain_viterbi(vocab, word):
    best, count = [0.0], [0]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(max(0, end - vocab.longest), end):
            i = vocab.index.get(word[start:end])
            if i is not None:
                options.append((best[start] + vocab.scores[i], end - start, count[start] + 1))
            elif end - start == 1:
                options.append((best[start] + vocab.scores.min() - 10, 1, count[start] + len(word[start:end].encode())))
        top = max(options)
        best.append(top[0])
        count.append(top[2])
    return best[-1], count[-1]


def test_trie_and_viterbi_equal_plain_dynamic_programming(vocab):
    unigram = vocab.with_rank_scores()
    rng = random.Random(4)
    ws = sorted({"▁" + "".join(rng.choice("abcdehilnorsté日") for _ in range(rng.randrange(1, 40))) for _ in range(200)} | {"▁hello", "▁", "\n"})
    want = [plain_viterbi(unigram, w) for w in ws]
    assert op3_tokens.trie_counts(unigram, ws).tolist() == [c for _, c in want] == segment(unigram, ws, True)[1].tolist()
    for w, (score, _) in zip(ws, want):
        assert abs(viterbi(unigram, codes_of(w)[None, :])[1][0] - score) < 1e-9


def test_token_counts(spark, vocab):
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in op3_tokens.token_counts(docs(spark, [*ODD, "Hello world"])).collect()}
    unigram = vocab.with_rank_scores()
    assert got[0] == got[1] == (0, 0) and got[4] == got[5]
    assert got[8] == (2, plain_viterbi(unigram, "▁Hello")[1] + plain_viterbi(unigram, "▁world")[1])
    whole = op3_tokens.token_counts(docs(spark, ["a", "b", "c"], ids=[None, BIG, BIG + 1]).coalesce(1)).collect()
    assert {r.doc_id for r in whole} == {None, BIG, BIG + 1}
    assert op3_tokens.token_counts(docs(spark, [])).count() == 0


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "<\\|end|>", "<\\\\|end|>\\", "<", "|end|>", "", None, "{{ m.text }}{% endfor %}", "日本\n語", LONG]
    turns = [(c, t, "assistant" if t % 2 else "user", nasty[(c + t) % len(nasty)], 1) for c in range(6) for t in range(5)]
    turns += [(50, 0, None, "x", 1), (50, 0, "user", "x", 1), (50, 0, "user", "x", 1), (50, None, "a\nb<|text|>", "y", 1), (None, 0, "assistant", "z", 1)]
    got = op5_chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, spans int")).collect()
    assert len(got) == 8
    for r in got:
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text, _ in turns if c == r.conv_id))
        assert op5_chat.read_back(r.formatted) == [(x[2], x[3]) for x in own]
        loss = "".join(op5_chat.unescape(r.formatted[a:b]) for a, b in r.spans)
        assert loss == "".join(x[3] for x in own if x[2] == "assistant")
    assert op5_chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_few_and_long(spark):
    """More tasks than conversations, a text of five million characters, a conversation -1 in the table, whole ids beside null."""
    schema = "conv_id long, turn long, role string, text string"
    spread = spark.createDataFrame([(1, 0, "user", "hi")], schema).repartition(16)
    assert op5_chat.format_chats(spread).count() == 1
    long = spark.createDataFrame([(1, 0, "user", "a</s>" * 1_000_000), (1, 1, "assistant", "b")], schema)
    row = op5_chat.format_chats(long.coalesce(1)).mapInArrow(op5_chat._digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").first()
    assert row.n_turns == 2 and row.loss_chars == 1 and row.formatted_chars > 6_000_000
    ids = op5_chat.format_chats(spark.createDataFrame([(None, 0, "user", "x"), (BIG, 0, "user", "y"), (BIG + 1, 0, "user", "z")], schema).coalesce(1))
    assert {r.conv_id for r in ids.collect()} == {None, BIG, BIG + 1}


def test_chat_query_keeps_a_conversation_of_its_own_apart(spark, tmp_path):
    spark.createDataFrame([(-1, 0, "user", "mine"), (2, 0, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.conv_id, r.n_turns) for r in op5_chat.op5_chat_format(spark, str(tmp_path)).collect())
    assert got == [(-1, 1), (-1, 2), (2, 1)]


def test_templates():
    render = op5_chat.compile_template("{% set x = 'a' + 'b' | upper %}{% for m in messages %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}{% if 1 == 2 %}no{% elif 'y' %}yes{% endif %}")
    assert render([{"role": "r", "text": "t"}] * 2)[0] == "1aB,2aByes"
    assert op5_chat.parse("{{ 'a' + 'b' }}{% if true %}c{% endif %}") == [("text", "abc")]
    for bad in ("{{ x.__class__ }}", "{{ messages | pop }}", "{% for m in %}", "{% if x %}", "{{ 1 + }}", "{% import os %}"):
        with pytest.raises(op5_chat.TemplateError):
            op5_chat.compile_template(bad)([])


def exact_brute(texts):
    plain = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    out = {}
    for i, p in enumerate(plain):
        own = [j for j, q in enumerate(plain) if q == p]
        out[i] = (min(own, key=lambda j: (-len(texts[j] or ""), j)), len(own), hashlib.sha256(p.encode()).hexdigest())
    return out


@pytest.mark.parametrize("key_bits", [64, 3])
def test_exact(spark, key_bits):
    rng = random.Random(5)
    texts = [*ODD, *(" ".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(120)), "a\u00a0b", "a b "]
    got = op6_exact.exact_dedup(docs(spark, texts), capacity=4, key_bits=key_bits).collect()
    want = exact_brute(texts)
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == want and all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert key_bits == 64 or max(r.chain for r in got) > 1  # collisions are chained
    assert op6_exact.exact_dedup(docs(spark, [])).count() == 0


def test_exact_null_and_whole_ids(spark):
    texts = ["a b", "ab", "ab", "x", "y", "y", None, ""]
    ids = [BIG, None, 7, None, None, None, BIG + 1, 3]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in op6_exact.exact_dedup(docs(spark, texts, ids=ids).coalesce(1)).collect()), key=str)
    want = [(BIG, BIG, 3, True), (None, BIG, 3, False), (7, BIG, 3, False), (None, None, 1, True), (None, None, 2, True), (None, None, 2, True), (BIG + 1, 3, 2, False), (3, 3, 2, True)]
    assert got == sorted(want, key=str)


def test_exact_hot_text(spark):
    """A text of most rows is met by broadcast, in several partitions and tasks."""
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("t"), F.col("id"))).otherwise(F.lit("hot text")).alias("text"))
    got = op6_exact.exact_dedup(rows.withColumnRenamed("id", "doc_id").repartition(7)).groupBy("keep_id", "group_size").count().where("group_size > 1").collect()
    assert [(r.keep_id, r.group_size, r["count"]) for r in got] == [(1, 2666, 2666)]


def test_directory_splits_overfull_buckets():
    rng = np.random.default_rng(6)
    cells = rng.integers(0, 9, 64)
    cells[5] = 500  # can't be divided by any more bits
    directory = op6_exact.grow_directory(cells, 40)
    load = np.bincount(directory[np.arange(64) & (len(directory) - 1)], cells)
    assert len(directory) == 64 and sorted(load)[-1] == 500 and sorted(load)[-2] <= 40 and load.sum() == cells.sum()
    assert len(op6_exact.grow_directory(np.zeros(16, dtype=int), 1)) == 1


PAGES = "page_id long, url string, html string, verdict string"


def test_urls(spark):
    fixed = [None, "", "nothing", "http://A.Example.NET/en/x?y#z", "https://net/", "https://net", "http://example.com/de/1", "http://notexample.com/de/1", "https://a.org/fr/", "http://x.internet/", "HTTP://EXAMPLE.ORG/fr/a://b", "http://é.net/ü"]
    rng = random.Random(7)
    more = [f"https://{rng.choice(['a', 'b'])}.example.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(9999)}" for _ in range(300)]
    urls = [*fixed, *more]
    rows = op7_urls.url_filter(spark.createDataFrame([(i, u, "", "q") for i, u in enumerate(urls)], PAGES)).collect()
    assert len(rows) == len(urls)
    for r in rows:
        rest = (urls[r.page_id] or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in op7_urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")
    empty = op7_urls.url_filter(spark.createDataFrame([], PAGES))
    assert empty.count() == 0
    free = op7_urls.url_filter(spark.createDataFrame([(1, "http://a.com/", "", "q")], PAGES)).first()
    assert free.verdict == "allow" and free.score is None


def test_trees_learn():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    model = op7_urls.BoostedTrees().fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0) == (y[2000:] > 0.5)).mean() > 0.95


def plain_tree(tree, row):
    while isinstance(tree, tuple):
        j, cut, below, above = tree
        tree = below if row[j] <= cut else above
    return tree


def test_url_verdicts_against_plain_trees(spark):
    """Every verdict again, row by row in plain Python, from the labelled URLs of the table."""
    rng = random.Random(17)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['a-b', 'shop', 'x9'])}.example.{rng.choice(['com', 'org', 'net', 'info'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(10 ** rng.randrange(1, 9))}{rng.choice(['', '?a=1&b=2', '#t', '.html'])}" for _ in range(500)]
    urls += [None, "none", *urls[:200]]
    pages = spark.createDataFrame([(BIG + i if i else None, u, "", "q") for i, u in enumerate(urls)], PAGES).coalesce(1)
    model = op7_urls.Model(*op7_urls.labelled(op7_urls.with_rules(pages)))
    rows = op7_urls.url_filter(pages).collect()
    assert sorted((r.page_id for r in rows), key=str) == sorted([None, *(BIG + i for i in range(1, len(urls)))], key=str)
    known = {}
    for r in rows:
        if r.rule:
            known.setdefault(urls[r.page_id - BIG if r.page_id else 0], (r.host, r.path, r.verdict == "block"))
    odds = [{}, {}, {}]
    for host, path, y in known.values():
        for of, key in zip(odds, op7_urls._suffixes(host, path)):
            own = of.setdefault(key, [0, 0])
            own[y] += 1
    kinds = set()
    for r in rows:
        url = urls[r.page_id - BIG if r.page_id else 0]
        if r.rule is None:
            plain = [float(x) for x in op7_urls.lexical([url], [r.host], [r.path])[0]]
            for of, key in zip(odds, op7_urls._suffixes(r.host, r.path)):
                a, b = of.get(key, (0, 0))
                plain.append(math.log((b + 1) / (a + 1)))
            score = model.trees.start + model.trees.rate * sum(plain_tree(t, plain) for t in model.trees.trees)
            assert math.isclose(r.score, 1 / (1 + math.exp(-score)), rel_tol=1e-9) and r.verdict == ("block" if r.score >= 0.5 else "allow")
            kinds.add(r.verdict)
    assert kinds == {"allow", "block"}
    right, n = op7_urls.held_out_accuracy(pages)
    assert n > 20 and right > 0.9


def test_suffix_statistics_leave_own_fold_out():
    keys, y, fold = np.array([[1, 2, 3]] * 5 + [[1, 9, 9]]), np.array([1.0, 1, 1, 1, 1, 0]), np.array([0, 1, 2, 3, 4, 0])
    got = op7_urls.out_of_fold(keys, y, fold)
    assert got[5, 1] == 0 and math.isclose(got[0, 1], math.log(5)) and math.isclose(got[1, 0], math.log(5 / 2))


def test_hot_url_is_one_row_of_the_sample(spark):
    urls = ["https://a.net/hot"] * 3000 + [f"https://x.example.com/de/{i}" for i in range(50)] + [f"https://b.org/fr/{i}" for i in range(50)]
    x, _, y, _ = op7_urls.labelled(op7_urls.with_rules(spark.createDataFrame([(i, u, "", "") for i, u in enumerate(urls)], PAGES)), sample=90)
    assert len(y) == 90 and 30 < y.sum() < 60


def test_trees_split_like_plain_search():
    """The first split of a tree against a search over all cuts."""
    rng = np.random.default_rng(18)
    x = rng.integers(0, 6, size=(80, 3)).astype(float)
    y = (x[:, 1] + rng.normal(size=80) > 3).astype(float)
    tree = op7_urls.BoostedTrees(trees=1, depth=1).fit(x, y).trees[0]
    p = y.mean()
    grad, hess = p - y, np.full(80, p * (1 - p))
    best = {}
    for j in range(3):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])):
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= 8:
                best[j, cut] = sum(grad[s].sum() ** 2 / (hess[s].sum() + 1) for s in (left, ~left))
    assert math.isclose(best[tree[:2]], max(best.values()))
    left = x[:, tree[0]] <= tree[1]
    assert math.isclose(tree[2], -grad[left].sum() / (hess[left].sum() + 1)) and math.isclose(tree[3], -grad[~left].sum() / (hess[~left].sum() + 1))


def nearest_brute(rows, k):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            near = sorted(((-float(sum(a * b for a, b in zip(v, w))), j) for j, w in good if j != i and len(w) == len(v)))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(400)]
    rows += [(i, rows[20][1]) for i in range(400, 460)]  # many ties
    rows += [(460, None), (480, [0.0] * 16), (500, [float("nan")] * 16), (520, [None] * 16), (540, [float("inf")] * 16), (560, []), (580, [1.0, 2.0]), (581, [3.0, 4.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, block int")
    got = {}
    for r in op8_ann.nearest(df, F.col("vec_id") % 20 == 0, k=20, query_block=7, block=32).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = nearest_brute(rows, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)
    assert op8_ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("size, unit", [(400, 1e200), (400, 1e-323), (2, 1e200), (60, 1e150), (60, 1e-150), (400, 1.0)])
def test_nearest_at_the_ends_of_doubles(spark, size, unit):
    """Products that overflow, underflow or mix all magnitudes, against float64."""
    rng = np.random.default_rng(int(size))
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6) * 4) * (unit if unit != 1.0 else 10.0 ** rng.integers(-300, 300))]) for i in range(size)]
    df = spark.createDataFrame([(i, v) for i, v in rows] + [(None, [1.0] * 6)], "vec_id long, embedding array<double>")
    got = {}
    for r in op8_ann.nearest(df, F.col("vec_id") % 20 == 0, query_block=9, block=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    good = [(i, v) for i, v in rows if any(v)]
    for i, v in good:
        if i % 20 == 0:
            with np.errstate(all="ignore"):
                scored = [(float(op8_ann.inner(np.array([v]), np.array([w]))[0]), j) for j, w in good if j != i]
            want = sorted(scored, key=lambda x: (not math.isnan(x[0]), -x[0] if not math.isnan(x[0]) else 0, x[1]))[:20]
            assert [j for j, _ in got[i]] == [j for _, j in want], i
            assert all(a == b or math.isnan(a) and math.isnan(b) for (_, a), (b, _) in zip(got[i], want))


def test_nearest_equal_vectors_and_whole_ids(spark):
    """One vector fills most of the table: its smallest ids stand for it; repeated ids are candidates, but not their own query's."""
    rows = [(BIG + i, [1.0, 2.0]) for i in range(600)] + [(i, [2.0, 1.0]) for i in (20, 20, 21, 22)] + [(40, [0.5, 0.5]), (40, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in op8_ann.nearest(df, F.col("vec_id") == 20, k=5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {20: [(40, 9.0), (21, 5.0), (22, 5.0), (BIG, 4.0), (BIG + 1, 4.0)]}
    own = [(r.vec_id, r.score) for r in op8_ann.nearest(df, F.col("vec_id") == 21, k=5).orderBy("rank").collect()]
    assert own == [(40, 9.0), (20, 5.0), (20, 5.0), (22, 5.0), (BIG, 4.0)]


def test_tasks_keep_floors_across_tiles():
    """What a task gives out is cut at the floors of all its tiles, not of each."""
    rng = np.random.default_rng(19)
    x, y = rng.normal(size=(10, 8)), rng.normal(size=(4000, 8))
    make = lambda v, first: op8_ann.Tile(8, len(v), np.arange(first, first + len(v)).tobytes(), np.full(len(v), op8_ann.NONE + 1 + first).tobytes(), *(a.tobytes() for a in op8_ann.quantise(v)))
    s = op8_ann.Survivors(make(x, 10**6), 20)
    for i in range(0, 4000, 100):
        s.add(make(y[i : i + 100], i))
    out = s.batch().to_pydict()
    assert len(out["row"]) < 10 * 60  # 40 tiles of 20 each would be 8,000
    for i in range(10):
        best = set(np.argsort(-(y @ x[i]))[:20].tolist())
        assert best <= {r for q, r in zip(out["query"], out["row"]) if q == 10**6 + i}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_brute(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    label = list(range(len(texts)))
    moved = True
    while moved:
        moved = False
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if x and y and label[i] != label[j] and 100 * len(x & y) >= percent * len(x | y):
                    label = [min(label[i], label[j]) if v in (label[i], label[j]) else v for v in label]
                    moved = True
    return {i: (len(s), label[i]) for i, s in enumerate(sets)}


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(op9_neardup, "BLOCK", 8)  # buckets of several blocks
    rng = random.Random(10)
    texts = [*ODD, "A b C", "a B c", "one", "One", "one two"]
    base = words(rng, 120).split()
    for _ in range(60):  # copies of one text whose likeness runs to both sides of the threshold
        own = list(base)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(len(own))] = "x%d" % rng.randrange(99)
        texts.append(" ".join(own))
    passage = words(rng, 60)
    texts += [f"{words(rng, rng.randrange(5, 40))} {passage}" for _ in range(30)] + [words(rng, 50) for _ in range(20)]
    for k, t in ((3, 0.85), (5, 0.8)):
        got = op9_neardup.near_duplicates(docs(spark, texts), k, t).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_brute(texts, k, round(100 * t)) and all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert op9_neardup.near_duplicates(docs(spark, [])).count() == 0
    assert op9_neardup.near_duplicates(docs(spark, [None, ""])).count() == 2


def test_near_duplicates_odd_ids(spark):
    """Null ids are linked with nothing; several texts of one id link through it; ids stay whole."""
    rng = random.Random(23)
    a, b, c = words(rng, 50), words(rng, 50), words(rng, 50)
    texts, ids = [a, b, a, b, c, c, None, ""], [BIG, BIG, BIG + 1, 9, None, BIG + 2, None, 4]
    got = sorted(((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in op9_neardup.near_duplicates(docs(spark, texts, ids=ids).coalesce(1), 3, 0.85).collect()), key=str)
    want = [(BIG, True, 9, False), (BIG, True, 9, False), (BIG + 1, True, 9, False), (9, True, 9, True), (None, True, None, True), (BIG + 2, True, BIG + 2, True), (None, False, None, True), (4, False, 4, True)]
    assert got == sorted(want, key=str)


def test_near_duplicates_large_bucket(spark):
    """A bucket that the sample shows to be large is walked in parts."""
    rng = random.Random(24)
    base = words(rng, 200).split()
    texts = [" ".join(base[:i] + [f"y{i}"] + base[i + 1 :]) for i in range(150)] + [words(rng, 30) for _ in range(10)]
    got = op9_neardup.near_duplicates(docs(spark, texts), 3, 0.85).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 0 if i < 150 else i for i in range(160)}


def test_likelihood_estimates_similarity():
    rng = np.random.default_rng(11)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for share in (0.2, 0.5, 0.9):
        n = int(1000 * share)
        a, b = np.unique(pool[:1000]), np.unique(np.concatenate([pool[:n], pool[1000 : 2000 - n]]))
        regs = op9_neardup.registers([a, b], 1024)
        assert abs(op9_neardup.likely(regs[:1], regs[1:], np.array([1000.0]), np.array([1000.0]))[0] - n / (2000 - n)) < 0.06
    # Registers of a union are the maxima of the parts'.
    x = op9_neardup.registers([pool[:10], pool[10:30], pool[:30]], 64)
    assert (np.maximum(x[0], x[1]) == x[2]).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_folding():
    assert op10_toxicity.fold("You 1D10T, stüpid Ｌoser") == op10_toxicity.fold("you idiot stüpid loser")
    assert op10_toxicity.fold("ѕсum") == op10_toxicity.fold("scum") and op10_toxicity.fold("i​diot!") == op10_toxicity.fold("idiot")
    machine = op10_toxicity.automaton({op10_toxicity.fold("trash"): 4.0})
    assert op10_toxicity.matches(machine, op10_toxicity.fold("take out the trash, you trash"))[1] == 1


def test_automaton_against_plain_search(spark):
    """Scores again from a plain search for every term at every word."""
    rng = random.Random(25)
    lexicon = {" ab ": 2.0, " abc ": 3.0, " ab": 1.0, " trash ": 4.0}
    machine = op10_toxicity.automaton(lexicon)
    spared = [op10_toxicity.fold(p) for p in op10_toxicity.EXCEPTIONS]
    for _ in range(300):
        text = op10_toxicity.fold(" ".join(rng.choice(["ab", "abc", "abcd", "trash", "can", "bin", "x"]) for _ in range(rng.randrange(12))))
        inside = {at for p in spared for i in range(len(text)) if text.startswith(p, i) for at in range(i, i + len(p) - 1)}  # the last space is the next word's
        hits = {}
        for i in range(len(text)):
            own = [w for t, w in lexicon.items() if text.startswith(t, i)]
            if own and i not in inside:
                hits[i] = max(own)
        assert op10_toxicity.matches(machine, text) == (sum(hits.values()), len(hits))


def test_toxicity_few_labels_many_tasks(spark):
    """More partitions than labelled rows, null and whole ids, repeated ids with several texts."""
    texts = ["idiot moron you", "fine words here", "other fine words", None, "idiot"] + ["plain"] * 60
    ids = [0, 3, 4, BIG, None] + [3] * 60
    df = docs(spark, texts, ids=ids).repartition(32)
    lab = spark.createDataFrame([(0, 1, 1), (3, 1, 0), (4, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").repartition(8)
    got = op10_toxicity.toxicity(df, lab).collect()
    assert len(got) == 65 and {r.doc_id for r in got} == {0, 3, 4, BIG, None}
    assert op10_toxicity.without_toxic(df, lab).count() == sum(not r.predicted for r in got)
    one = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    assert op10_toxicity.toxicity(df, one).count() == 65


def test_session_setting_stays(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = docs(spark, ["a b c", "d e f"])
    op9_neardup.near_duplicates(df).collect()
    op10_toxicity.toxicity(df, spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_toxicity(spark):
    rng = random.Random(12)
    bad = ["idiot", "moron", "grobnik"]
    texts, marks = [*ODD], [0] * 8
    for i in range(400):
        t = words(rng, 40).split()
        marks.append(int(i % 4 == 0))
        if marks[-1]:
            for _ in range(3):
                t[rng.randrange(40)] = rng.choice(bad)
        texts.append(" ".join(t))
    labels = [(i, 1, y) for i, y in enumerate(marks)] + [(3, None, None), (9999, 0, 1), (5, 0, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in op10_toxicity.toxicity(docs(spark, texts), lab).collect()}
    assert len(got) == len(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    assert np.mean([got[i].predicted == y for i, y in enumerate(marks)]) > 0.97
    kept = op10_toxicity.without_toxic(docs(spark, texts), lab)
    assert kept.columns == docs(spark, texts).columns and kept.count() == sum(not r.predicted for r in got.values())
    none = lab.where("doc_id < 0")
    assert {r.doc_id for r in op10_toxicity.toxicity(docs(spark, ["you idiot moron idiot", "fine", None]), none).collect() if r.predicted} == {0}
    assert op10_toxicity.toxicity(docs(spark, []), lab).count() == 0
