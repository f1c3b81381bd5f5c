"""The odd cases every operator is run on."""

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = {
    "en": "the quick brown fox jumps over the lazy dog and then the other animals follow it into the forest where nobody has been before",
    "de": "der schnelle braune Fuchs springt über den faulen Hund und dann folgen ihm die anderen Tiere in den Wald wo noch niemand war",
    "fr": "le rapide renard brun saute par dessus le chien paresseux et puis les autres animaux le suivent dans la forêt où personne n'est allé",
}
ROWS = [
    (1, PROSE["en"], "en", "a", 10), (2, PROSE["en"], "en", "a", 10), (3, PROSE["en"] + " today", "en", "b", 10), (4, PROSE["de"], "de", "b", 10),
    (5, PROSE["fr"], "fr", None, None), (6, None, None, None, None), (7, "", "en", "a", 0), (8, " \t\n ", None, "c", 3), (None, PROSE["de"], None, "c", 1),
    (None, None, None, None, None), (9, "12 34 -- !!", "en", "c", 11), (10, (PROSE["en"] + ". ") * 300, "en", "a", 30_000), (10, (PROSE["en"] + ". ") * 300, "en", "a", 30_000),
    (11, "é" * 500 + "\u0000" + "x" * 20, "fr", "d", 521), (12, "single", "en", "d", 6), (13, "two words", "en", "d", 9),
]
CLASHES = [
    "size", "shard", "slot", "h", "w", "node", "v", "part", "fp", "component_id", "k", "n", "label", "lang_pred", "score", "predicted", "blob", "spans", "target", "copies", "taken",
    "base", "x", "block", "row_key", "runs", "inter", "a", "lo", "hi", "bytes", "record", "kind", "item_id", "media", "n_bytes", "y", "rn", "_pid", "_rn", "_row", "_keep_id", "_mix_key",
]
