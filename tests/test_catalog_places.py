"""Stat layouts and the locating cascade by plain loops over the same texts."""

import random
import re

import pytest

from tomeforge.operators import catalog

PARTS = [
    "Red Orc: F1, H2, R3, A4, PdF5, swims\n", "Old Ogre\nF 1O; H 2; R l\nA 2S PdF O\n", "Tiny Elf\nCON 1S, FR 4, DEX 7, AGI 8\n", "garras 1d6\n", "some words that are here.\n", "RED ORC\nF9 H9 R9 A9 PdF9\n",
    "Troll: F1, H2, R3, A4, PdF5\nF6, H6, R6, A6, PdF6\n", "F1, H1, R1, A1, PdF1 ", "\n", "Bite-Bat\nmordida\nF2 H2 R2 A2 PdF2\n", "42: F1, H2, R3, A4, PdF5\n",
]


def plain_blocks(text, offsets):
    """(start, end, layout, nome, page, description) by finditer and a list of taken intervals."""
    pats = [re.compile(re.sub(r"\\p\{L\}", "A-Za-zÀ-ÿ", p)) for p, _ in catalog.LAYOUTS]
    taken = []
    for k, p in enumerate(pats):
        found = list(p.finditer(text))
        for i, m in enumerate(found):
            gap = text[found[i - 1].end() if i else 0 : m.start()]
            if any(a < m.end() and m.start() < b for a, b, layout, _ in taken if layout < k):
                continue
            name = m[0].split(":")[0].strip() if k == 0 else None
            if k:
                lines = [x.strip() for x in gap.split("\n")]
                able = [x for x in lines if re.match(r"^[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ '-]{2,49}$", x) and not re.match(r"(?i)con |mordida|garras", x)]
                name = able[-1] if able else None
            taken.append((m.start(), m.end(), k, name))
    real = sorted(t for t in taken if t[3] and 3 <= len(t[3]) <= 50 and not re.match(r"^[\d\s-]+$", t[3]))
    out, seen = [], set()
    for i, (a, b, k, name) in sorted(enumerate(real), key=lambda x: (x[1][2], x[1][0])):
        if name.lower() not in seen:
            seen.add(name.lower())
            end = real[i + 1][0] if i + 1 < len(real) else len(text)
            out.append((a, b, k, name, max(p for p, s in offsets if s <= a), text[b:end].strip()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_stat_blocks_by_loops(spark, seed):
    rnd = random.Random(seed)
    texts = {k: "".join(rnd.choices(PARTS, k=rnd.randrange(0, 14))) for k in range(40)}
    pages = spark.createDataFrame([(k, p, t[40 * p : 40 * p + 38]) for k, t in texts.items() for p in range(len(t) // 40 + 1)], "doc_id int, page int, text string")
    offsets = catalog.page_offsets(pages)
    starts = {}
    for r in offsets.collect():
        starts.setdefault(r.doc_id, []).append((r.page, r.start))
    assert starts[0] == [(p, 40 * p) for p in range(len(starts[0]))]
    docs = spark.createDataFrame([*texts.items(), (99, None)], "doc_id int, text string")
    got = {}
    for r in catalog.stat_blocks(docs, offsets=offsets).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.layout, r.nome, r.page, r.description))
    want = {k: rows for k, t in texts.items() if (rows := plain_blocks(t, starts[k]))}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 20
    ogre = [r for r in catalog.stat_blocks(docs).collect() if r.nome == "Old Ogre"][0]
    assert (ogre.forca, ogre.habilidade, ogre.resistencia, ogre.armadura, ogre.pdf, ogre.con) == ("10", "2", "1", "25", "0", None)


ENTRIES = [
    "Bola de Fogo\nEscola: Elemental.\nCusto: 5 PMs.\nAlcance: longo;\nDuração: um turno.\nUma bola.\n", "BOLA DE GELO\nEscola: Negra.\nCusto: 2 PMs.\nAlcance: curto;\nDuração: hora.\nFria.\n",
    "Bola mal lida\nExlgêncla: nada.\nCu1to: 3.\n", "Cura Magico\nEscola: Branca.\nCusto: 1.\nAlcance: toque;\nDuraçlo: sempre.\nCura tudo.\n", "Bola de Fogo é boa. ", "words " * 70, "Cura Mágica aqui. ", "Custo: 9.\n",
]
INDEX = ["Bola de Fogo", "Bola de Gelo", "Cura Mágica", "Cura Magicas", "Bolão", "Vento", "Ar", "Cur"]


def plain_entry(text, at):
    part = text[max(0, at - 100) : at + 2500]
    values = []
    for name, p in catalog.ENTRY_FIELDS.items():
        m = re.search(re.sub(r"\[\\p\{L\}", "[A-Za-zÀ-ÿ", p.replace(r"\z", r"\Z").replace(r"\p{L}", "A-Za-zÀ-ÿ").replace("[A-Za-zÀ-ÿ]", "[A-Za-zÀ-ÿ]")), part)
        values.append((m[1].strip() or None) if m else None)
    return at, sum(v is not None for v in values) / 5, *values


def fold(x):
    return x.lower().translate(str.maketrans("áàâãéêíóôõúüç", "aaaaeeiooouuc"))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, old = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(row[j] + 1, old[j + 1] + 1, old[j] + (x != y)))
    return row[-1]


def plain_search(name, text):
    """(method, entry) of a name in one book, step by step."""
    for method, f in (("exact", str), ("case", str.lower), ("accent", fold)):
        t, n = f(text), f(name)
        places, at = [], t.find(n)
        while at >= 0 and len(places) < 15:
            places.append(at)
            at = t.find(n, at + len(n))
        if not set(re.findall(r"\w+", fold(text))) & {max(re.findall(r"\w+", fold(n)), key=lambda w: (len(w), w))}:
            continue
        found = [e for e in (plain_entry(text, at) for at in places) if e[1] > 0.3]
        if found:
            return method, next((e for e in found if e[1] >= 0.8), max(found, key=lambda e: (e[1], -e[0])))
    word = name.split()[0]
    if len(word) > 3:
        for m in re.finditer(rf"(?i)(?<!\w){re.escape(word)}(?!\w)", text):
            if re.search(re.sub(r"\\p\{L\}", "A-Za-zÀ-ÿ", catalog.INDICATOR), text[m.start() : m.start() + 300]):
                return "first word", plain_entry(text, m.start())
    heads = {h.strip() for h in re.findall(catalog.HEADING.replace(r"[\p{L}]", "[A-Za-zÀ-ÿ]").replace(r"\p{L}", "A-Za-zÀ-ÿ"), text)}
    near = [(1 - distance(name, h) / max(len(name), len(h)), h) for h in heads if len(h) >= 4]
    near = [x for x in near if x[0] >= 0.75]
    if near:
        head = min(near, key=lambda x: (-x[0], x[1]))[1]
        return "fuzzy", plain_entry(text, text.find(head))
    return None


@pytest.mark.parametrize("seed", range(2))
def test_located_entries_by_loops(spark, seed):
    rnd = random.Random(seed)
    books = {k: "".join(rnd.choices(ENTRIES[2 * (k % 4) :] if k < 4 else ENTRIES, k=rnd.randrange(1, 6))) for k in range(8)}
    want = {}
    for name in INDEX:
        want[name] = (name, None, "missing", None)
        for k, text in books.items():
            hit = plain_search(name, text)
            if hit and hit[1][1] > 0.3:
                want[name] = (name, k, hit[0], *hit[1])
                break
    found = catalog.locate_entries(spark.createDataFrame([(n,) for n in [*INDEX, "Vento", " "]], "name string"), spark.createDataFrame([*books.items(), (50, None)], "doc_id int, text string"))
    got = {r["name"]: tuple(r) if r.doc_id is not None else tuple(r)[:4] for r in found.collect()}
    assert got == want
    assert len({w[2] for w in want.values()}) > 2 and found.columns[-5:] == list(catalog.ENTRY_FIELDS)


def test_variants_by_loops(spark):
    rnd = random.Random(6)
    parts = ["soldado Orc, ", "SOLDADO  ORC negro. ", "Xamã goblin F 3 H l. ", "chefe de tudo ", "arqueiro x1 ", "o Mago", " mago Elfo-Alto; ", "F9 H8 R7 A6 PdF5 ", "words " * 60, "elite e ", "Líder Troll\n"]
    texts = {k: "".join(rnd.choices(parts, k=rnd.randrange(0, 9))) for k in range(50)} | {99: None}
    blocks = [(k, "Soldado orc") for k in range(0, 50, 2)]
    got = {}
    for r in catalog.variants(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), spark.createDataFrame(blocks, "doc_id int, nome string")).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.nome, r.forca, r.habilidade, r.pdf))
    letters, want = "A-Za-zÀ-ÿ", {}
    for k, text in texts.items():
        seen = {"SOLDADO ORC"} if (k, "Soldado orc") in blocks else set()
        for m in re.finditer(rf"(?i)(?<![{letters}\d])(?:{'|'.join(catalog.RANKS)})\s+[{letters}][{letters}-]+(?:\s+[{letters}-]+)?(?![{letters}\d])", text or ""):
            words = m[0].upper().split()
            if words[1].lower() in catalog.NO_KIND or " ".join(words) in seen:
                continue
            seen.add(" ".join(words))
            near = text[max(0, m.start() - 250) : m.end() + 500]
            stats = [re.search(rf"(?<![{letters}\d]){x}\s*([\dOolIS]+)", near) for x in ("F", "H", "PdF")]
            want.setdefault(k, []).append((m.start(), " ".join(words), *(x and x[1].translate(str.maketrans("OolIS", "00115")) for x in stats)))
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 25


@pytest.mark.parametrize("first", [1, 3, 100])
def test_entries_in_late_books(spark, monkeypatch, first):
    """A name that the first books only mention is found in a later one, whatever number of books is looked at first; books behind it are not."""
    monkeypatch.setattr(catalog, "FIRST_BOOKS", first)
    entry = "{}\nEscola: Fogo.\nCusto: 2 PMs.\nAlcance: longo; Duração: curta.\n"
    books = [(k, "só Chama Azul e Vento") for k in range(10)] + [(10, entry.format("CHAMA AZUL")), (11, entry.format("Vento")), (12, entry.format("Chama Azul"))]
    books += [(k, entry.format("Chama Azul") + entry.format("Vento")) for k in range(20, 40)]
    found = catalog.locate_entries(spark.createDataFrame([("Chama Azul",), ("Vento",), ("Nada",)], "name string"), spark.createDataFrame(books, "doc_id int, text string"))
    assert sorted((r.name, r.doc_id or 0, r.method) for r in found.collect()) == [("Chama Azul", 10, "case"), ("Nada", 0, "missing"), ("Vento", 11, "exact")]
