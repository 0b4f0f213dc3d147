from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pricetide.llm import personal as pe

FINDER = pe.PersonalFinder(["dar guemra", "ain tazrout", "oued mirzane"])

CASES = [
    ("Mon mail : amel_m99@poste.webmel.example, rapide.", [("email", "amel_m99@poste.webmel.example")]), ("à hind.b arobase courriel point example.", [("email", "hind.b arobase courriel point example")]), ("Mail x99(at)etu(dot)univ-m(dot)example now", [("email", "x99(at)etu(dot)univ-m(dot)example")]),
    ("to fa-d AT boite-lettres DOT test.", [("email", "fa-d AT boite-lettres DOT test")]), ("selma9 (a) boite.test.", [("email", "selma9 (a) boite.test")]), ("On propose 6 pièces @ 25.600 DA l'unité", []), ("Contact A@B.EXAMPLE. Merci", [("email", "A@B.EXAMPLE")]),
    ("Tél +213 (0) 501 637 190 (WhatsApp).", [("phone", "+213 (0) 501 637 190")]), ("Joignable au 0601-005-106 après 18h.", [("phone", "0601-005-106")]), ("sms (0708) 826444 svp", [("phone", "(0708) 826444")]), ("call 00 213 500.762.289 now", [("phone", "00 213 500.762.289")]),
    ("الهاتف 021 00 46 23 بعد", [("phone", "021 00 46 23")]), ("Commande n° 0601005106 passée", []), ("Colis n° 006504555707333958 bloqué", []), ("prix 178 100 DA", []), ("timings 16-18-18-38", []), ("Version 1.7.35.137", []), ("Code-barres 2067461915027 sur", []),
    ("NIN : 12-6102-1588-5151-6140.", [("id_number", "12-6102-1588-5151-6140")]), ("Passeport B19675751 demandé", [("id_number", "B19675751")]), ("National ID: 434264976.", [("id_number", "434264976")]), ("Ma carte d'identité porte le numéro D30/292820, le", [("id_number", "D30/292820")]),
    ("S/N C1602486212 vérifié", []), ("رقم بطاقة التعريف 220 579 105 520 893 799.", [("id_number", "220 579 105 520 893 799")]), ("Passeprot B19675751 demandé", [("id_number", "B19675751")]),
    ("J'habite 11, av. des Tisserands, 52030 Dar Guemra, donc", [("address", "11, av. des Tisserands, 52030 Dar Guemra")]), ("Livré au 83 AVENUE DU VIEUX PUITS, DAR GUEMRA par", [("address", "83 AVENUE DU VIEUX PUITS, DAR GUEMRA")]),
    ("cité 2060 logements, bt 7, n° 3, Aïn Tazrout, donc", [("address", "cité 2060 logements, bt 7, n° 3, Aïn Tazrout")]), ("to Flat 20, 79 Old Lantern Close, Dar Guemra without", [("address", "Flat 20, 79 Old Lantern Close, Dar Guemra")]), ("العنوان: 176 شارع الزيتون، Dar Guemra.", [("address", "176 شارع الزيتون، Dar Guemra")]),
    ("107 bis, chemin Larbi-Zeroug - Dar Guemra par", [("address", "107 bis, chemin Larbi-Zeroug - Dar Guemra")]), ("lot. El Nakhla n°38, Dar Guemra.", [("address", "lot. El Nakhla n°38, Dar Guemra")]), ("Livraison vers Dar Guemra en 5 jours", []), ("Le modèle BD-22386 existe", []),
    ("Demandez M. Claire Zerrizel au comptoir.", [("name", "Claire Zerrizel")]), ("Demandez M. M. Zerrizel au comptoir.", [("name", "M. Zerrizel")]), ("vendue par Priya A. Gueskarif, très", [("name", "Priya A. Gueskarif")]), ("Sold by BOUNIZEL Sonia, trustworthy", [("name", "BOUNIZEL Sonia")]),
    ("Signé : Hind MESKZAOURT Le vendeur", [("name", "Hind MESKZAOURT")]), ("البائع أمال بن زريف محترم جدا.", [("name", "أمال بن زريف")]), ("Vendue comme neuve par Lazurel Store, mais", []), ("Contact sonia tirkarif <a.b@c.example>", [("name", "sonia tirkarif"), ("email", "a.b@c.example")]), ("Regards, owen boufanour", [("name", "owen boufanour")]),
    ("Voici le 220 579 105 520 893 799 merci", [("id_number", "220 579 105 520 893 799")]), ("", []), (None, []),
]


@pytest.mark.parametrize("text, want", CASES)
def test_findings(text, want):
    assert [(f.kind, text[f.begin:f.end]) for f in FINDER.find(text)] == want


def test_placeholders():
    text = "Sold by Owen Boufanour, call 0601-005-106."
    assert pe.placeholders(text, FINDER.find(text)) == "Sold by [NAME], call [PHONE]."
    assert pe.placeholders(None, []) is None and pe.placeholders("x", []) == "x"


def test_tables(spark):
    none = spark.createDataFrame([], 'place string')
    docs = spark.createDataFrame([(1, "Tél 0601-005-106 et 0601-005-106"), (1, "Tél 0601-005-106 et 0601-005-106"), (2, None), (3, ""), (None, "Tél 0601-005-106"), (4, "x" * 200_000), (5, "0601-005-106 rue " * 3_000)], "doc_id long, text string").withColumns({"pii_type": F.lit("clash"), "pii_text": F.lit(1)})
    got = {tuple(r) for r in pe.found(docs, none).collect()}
    assert got == {(1, "phone", "0601-005-106"), (5, "phone", "0601-005-106")}
    assert {r["doc_id"]: r["text"] for r in pe.redacted(docs.where("doc_id < 4"), none).collect()} == {1: "Tél [PHONE] et [PHONE]", 2: None, 3: ""}
    assert pe.found(docs.limit(0), none).count() == 0


def test_places(spark):
    df = spark.createDataFrame([("Dar Guemra",)] * 60 + [("Aïn Tazrout",), ("DAR-GUEMRA",), (None,), ("",)], "location string")
    assert sorted(r[0] for r in pe.place_names([(df, "location")]).collect()) == ["ain tazrout", "dar guemra"]
    assert pe.place_names([(df.limit(0), "location")]).count() == 0


def test_a_long_gazetteer_gives_the_same(spark):
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CASES)] + [(900, "11 rue X Y, Grand Dar Guemra Est"), (901, None)], "doc_id long, text string")
    places = spark.createDataFrame([("dar guemra",), ("ain tazrout",), ("grand dar guemra est",), ("elsewhere",)], "place string")
    short, long = ({tuple(r) for r in pe.found(docs, places, most_places=n).collect()} for n in (100, 2))
    assert short == long and (900, "address", "11 rue X Y, Grand Dar Guemra Est") in short
    assert len(short) == sum(len(set(want)) for _, want in CASES) + 1
    assert sorted(map(tuple, pe.redacted(docs, places).collect())) == sorted(map(tuple, pe.redacted(docs, places, most_places=2).collect()))


@pytest.mark.parametrize("automaton, kinds", [("marks", {"email", "phone"}), ("shapes", {"id_number"}), ("cues", {"id_number", "address", "name"})])
def test_findings_come_from_the_anchors(automaton, kinds):
    """Each automaton emptied takes the findings of its anchors away."""
    full = [f.kind for text, _ in CASES for f in FINDER.find(text)]
    bare = pe.PersonalFinder(["dar guemra", "ain tazrout", "oued mirzane"])
    empty = pe.ahocorasick.Automaton()
    empty.add_word("\x00", ("", 1) if automaton != "shapes" else 1)
    empty.make_automaton()
    setattr(bare, automaton, empty)
    left = [f.kind for text, _ in CASES for f in bare.find(text)]
    assert all(left.count(k) < full.count(k) for k in kinds)
