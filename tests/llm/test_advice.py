"""Cases of the review's findings on the training-data operators."""

import random
import string
import time

import numpy as np

from docloom.llm import embedding_dedup, html_extract, packing, secret_scan


def test_template_decides_inside_articles(spark):
    page = "<body><article><h1>Title {0}</h1><div class='k7'>Order our print edition today</div><p>First {0}</article><article><p>Second {0}, longer</article><div class='k8'>Told by {0}</div></body>"
    copy = "<body><article><h1>Same</h1><p>Whole</article></body>"
    rows = [(i, "https://h.example/x", page.format(i)) for i in range(6)] + [(i, "https://c.example/x", copy) for i in range(10, 16)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\nFirst {i}\nSecond {i}, longer\nTold by {i}" for i in range(6)} | {i: "Same\nWhole" for i in range(10, 16)}


def test_every_random_key_is_novel_and_copies_do_not_prime():
    rng = random.Random(5)
    for letters in (string.ascii_letters, string.ascii_letters + string.digits + "+/", string.digits):
        for n in (16, 20, 24, 40):
            for gap in (3, 120):
                key = "".join(rng.choice(letters) for _ in range(n))
                text = f"the auth header carries {key} and then {'some more words ' * gap}with auth again {key}. The end"
                found = [text[s:e] for s, _, e in secret_scan.novel_spans(text, [])]
                assert found == [key, f"{key}."], (found, key)
    words = "the auth header carries configuration_settings_directory and the auth token count is ================="
    assert secret_scan.novel_spans(words, []) == []


def test_a_copy_at_the_edge_of_the_context_does_not_prime():
    key = "qZrtWpLmXvBnKjHgFdSaTyUiOpQwErAsDfGhJkLz"
    for cut in range(len(key) + 1):
        text = f"auth {key}" + (" x y" * secret_scan.AROUND)[: secret_scan.AROUND - cut - 1] + f" {key} end"
        assert (5, 3, 5 + len(key)) in secret_scan.novel_spans(text, []), cut


def test_linear_program_of_many_classes_in_a_live_session(spark):
    assert spark.range(10).count() == 10
    rng = np.random.default_rng(2)
    sizes, demand = np.arange(1, 257), rng.integers(1, 60, 256)
    began = time.time()
    patterns = packing.cutting_stock(sizes, demand, 256)
    assert time.time() - began < 60
    assert (sum(c * n for c, n in patterns) == demand).all() and all((c * sizes).sum() <= 256 for c, _ in patterns)
    used, least = sum(n for _, n in patterns), -(-int((sizes * demand).sum()) // 256)
    assert least <= used <= least * 1.02
    matrix = rng.normal(size=(40, 40))
    assert np.allclose(packing._inverse(matrix), np.linalg.inv(matrix))


def test_embeddings_of_any_size_and_repeated_ids(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e-170, 1e-170], 1), (3, [1.0, 1.0], 1), (4, [5e-324, 0.0], 1), (5, [1e308, 1.0], 1), (6, [-1e200, 1e200], 1)]
    rows += [(7, [0.0, 1.0], 2), (7, [1.0, 0.0], 2), (7, [1.0, 0.0], 3), (8, [1.0, 0.01], 2), (9, [0.01, 1.0], 2), (3, [-0.0, 7.0], 2), (10, [1.0, 0.0], 3), (10, [1.0, 0.0], 3)]
    rng = np.random.default_rng(4)
    for i in range(200):
        a = rng.integers(0, 12) / 12 * np.pi
        rows.append((int(rng.integers(20, 60)), (10.0 ** int(rng.integers(-160, 160)) * np.array([np.cos(a + i * 1e-3), np.sin(a + i * 1e-3)])).tolist(), 4))
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)).collect()]
    x = np.array([r[1] for r in rows])
    x /= np.abs(x).max(1)[:, None]
    x /= np.sqrt((x * x).sum(1))[:, None]
    label = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    reach = link | np.eye(len(rows), dtype=bool)
    for _ in range(9):
        reach = reach @ reach
    least = [min(rows[j][0] for j in np.flatnonzero(reach[i])) for i in range(len(rows))]
    assert sorted(got) == sorted((r[0], int(link[i].sum()), least[i], r[0] == least[i]) for i, r in enumerate(rows))


#: Long words, links and identifiers of prose and code.
LONG_WORDS = """counterrevolutionaries internationalization Donaudampfschifffahrtsgesellschaft Lebensversicherungsgesellschaften
self-explanatory/straightforward anticonstitucionalmente incomprehensiblement Geschwindigkeitsbegrenzung electroencefalografista
Rechtsschutzversicherungsgesellschaften otorrinolaringologia constitutionnellement gouvernementalisation deinstitutionalization
uncharacteristically www.example.org/blog/2024/05/how-we-build-things example.com/articles/understanding-distributed-systems
github.com/project/repository/issues/1234 configuration_settings_directory getAuthenticationProviderFactory responsabilidades-compartidas
user_registration_confirmation_page static/images/background-header.png CONNECTION_TIMEOUT_SECONDS ThisIsAVeryLongIdentifierName""".split()
AROUND_THEM = [
    "The committee said that {0} {1} was a matter for the people who had come from many places to hear what the others would say about it in the end.",
    "Der Ausschuss hat gesagt, dass {0} {1} eine Sache der Menschen ist, die von weit her gekommen sind, um zu hören, was die anderen am Ende dazu sagen.",
    "Le comité a dit que {0} {1} est une affaire pour les gens qui sont venus de loin pour entendre ce que les autres diraient à la fin de la journée.",
    "El comité ha dicho que {0} {1} es un asunto de las personas que han venido de muchos lugares para escuchar lo que los otros dirían al final del día.",
]


def test_prose_stays_and_keys_are_found():
    found = [(w, c) for w in LONG_WORDS for t in AROUND_THEM for c in ("auth", "private", "the token", "password") if secret_scan.novel_spans(t.format(c, w), [])]
    assert len(found) <= 0.03 * len(LONG_WORDS) * 16, found
    for cue in ("author", "authentic", "authorities", "privately", "signatureless"):  # no sensitive words
        assert not any(secret_scan.novel_spans(t.format(cue, w), []) for w in [*LONG_WORDS, "qZrtWpLmXvBnKjHgFdSaTyUiOpQwErAs"] for t in AROUND_THEM)
    rng, missed, n = random.Random(1), [], 0
    low, digits = string.ascii_lowercase, string.digits
    for letters in (string.ascii_letters, string.ascii_letters + digits, string.ascii_letters + digits + "+/", digits, low, low + digits, low.upper() + digits):
        for size in (16, 20, 32, 40):
            for t in AROUND_THEM:
                for cue in ("authToken", "client_secret is", "the auth", "Private keys:"):
                    key = "".join(rng.choice(letters) for _ in range(size))
                    text, n = t.format(cue, key), n + 1
                    if not any(text[s:e].startswith(key) for s, _, e in secret_scan.novel_spans(text, [])):
                        missed.append(key)
    assert len(missed) <= 0.01 * n, missed


def test_redaction_keeps_prose(spark):
    rows = [(i, t.format("the author and the auth", w)) for i, w in enumerate(LONG_WORDS[:2] + LONG_WORDS[4:7]) for t in AROUND_THEM] + [(99, "auth qZrtWpLmXvBnKjHgFdSaTyUiOpQwErAs end")]
    got = {(r.doc_id, r.text) for r in secret_scan.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {*rows[:-1], (99, "auth [secret] end")}
