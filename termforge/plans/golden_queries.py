"""Queries of the annotator and the text kernels over a few inline texts, held against rows worked out by hand.

Each runs the very query of its name over a small folder of tables written once per session; the same over all documents is registered with
`_all` added to its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.functions.udfs import hash_embedder
from termforge.session import new_path

DOCUMENTS = [
    (1, "A cytokine storm (CS) came. CS left."),
    (2, "Fever in morning, fever at night"),
    (3, "Severe headache (IL6 at 39 °C)\nNew fever. The Storm"),
    (4, None),
    (5, ""),
]
#: id, dictionary, label, identifier, mode
ENTRIES = [
    (1, 1, "Cytokine storm", "HP:0033041", 0), (2, 1, "Fever", "HP:0001945", 0), (3, 1, "Headache", "HP:0002315", 0), (4, 1, "storm", "X:1", 1), (5, 1, "Night", "X:2", 2),
    (6, 2, "Morning", "X:3", 0), (7, 1, "Severe headaches", "HP:0002315", 0), (8, 3, "E. coli", "NCBITaxon:562", 0), (9, 4, "頭痛", "JA:1", 0), (10, 4, "サイトカインstorm", "JA:2", 0),
    (11, 1, "The Role of Cells", "X:4", 6), (12, 1, "IL-6 (alpha-beta)", "X:5", 0), (13, 1, "naïve T_cells 1,234.5", "X:6", 0), (14, 1, "Fever in morning", "X:7", 0),
    (15, 1, "morning fever", "X:8", 0), (16, 5, "두통 Fevers", "KO:1", 0),
]
#: id, name, public, threshold, language, context
DICTIONARIES = [(1, "clinical", True, 0.85, "en", "cytokine storm fever"), (2, "private", False, 0.85, "en", None), (3, "species", True, 1.0, "eng", "whale"), (4, "japanese", True, 0.85, "ja", None), (5, "korean", True, 0.85, "ko", None)]
#: id, dictionary, label, identifier, searchable: twelve of one word, of a dictionary that alone would fill the first ten
NEAR = [(100 + i, 16, "nights", f"N:{i}", True) for i in range(12)] + [(112, 16, "morning", "M:1", False)]
OTHER = [(200, 17, "nightly", "O:1"), (201, 17, "fevers", "O:2")]
_folders: dict[str, str] = {}


def folder(s: SparkSession) -> str:
    app = s.sparkContext.applicationId
    if app not in _folders:
        at = new_path(s, "golden")
        embed = hash_embedder(64)
        s.createDataFrame(DOCUMENTS, "doc_id long, text string").coalesce(1).write.parquet(f"{at}/documents.parquet")
        entry = "id long, dictionary_id long, label string, identifier string, mode int"
        e = s.createDataFrame(ENTRIES, entry).withColumn("embedding", F.lit(None).cast("array<double>"))
        e = e.unionByName(s.createDataFrame([(*r, 0) for r in OTHER], entry).withColumn("embedding", embed("label")))
        e = e.withColumns({"norm1": F.lower("label"), "norm2": F.lower("label"), "searchable": F.lit(True), "embedding": F.col("embedding").cast("array<float>")})
        e.coalesce(1).write.parquet(f"{at}/entries.parquet")
        words = {f"no_{c}_words": F.lit(None).cast("array<string>") for c in ("term", "begin", "end")}
        d = s.createDataFrame(DICTIONARIES, "id long, name string, public boolean, threshold double, language string, context string")
        d = d.withColumns(words | {"tokens_len_min": F.lit(1), "tokens_len_max": F.lit(4), "context_embedding": embed("context").cast("array<float>")})
        d.drop("context").coalesce(1).write.parquet(f"{at}/dictionaries.parquet")
        v = s.createDataFrame(NEAR, "id long, dictionary_id long, label string, identifier string, searchable boolean")
        v.withColumn("embedding", embed("label").cast("array<float>")).coalesce(1).write.parquet(f"{at}/semantic_dict_16.parquet")
        _folders[app] = at
    return _folders[app]


#: Per query its columns and rows, or the query whose rows it shares. Scores to six digits.
ROWS: dict[str, tuple[str, list[tuple]] | str] = {
    "ann_tokens": ("doc_id bigint, begin int, end int, token string", [
        (1, 0, 1, "a"), (1, 2, 10, "cytokine"), (1, 11, 16, "storm"), (1, 18, 20, "cs"), (1, 22, 26, "came"), (1, 28, 30, "cs"), (1, 31, 35, "left"), (2, 0, 5, "fever"),
        (2, 6, 8, "in"), (2, 9, 16, "morning"), (2, 18, 23, "fever"), (2, 24, 26, "at"), (2, 27, 32, "night"), (3, 0, 6, "severe"), (3, 7, 15, "headache"),
        (3, 17, 20, "il6"), (3, 21, 23, "at"), (3, 24, 26, "39"), (3, 28, 29, "c"), (3, 31, 34, "new"), (3, 35, 40, "fever"), (3, 42, 45, "the"), (3, 46, 51, "storm"),
    ]),
    "fn_tokenize": ("doc_id bigint, token string, norm2 string, begin int, end int, level int", [
        (1, "a", "a", 0, 1, 0), (1, "came", "came", 22, 26, 0), (1, "cs", "cs", 18, 20, 1), (1, "cs", "cs", 28, 30, 0), (1, "cytokine", "cytokin", 2, 10, 0),
        (1, "left", "left", 31, 35, 0), (1, "storm", "storm", 11, 16, 0), (2, "at", "", 24, 26, 0), (2, "fever", "fever", 0, 5, 0), (2, "fever", "fever", 18, 23, 0),
        (2, "in", "", 6, 8, 0), (2, "morning", "morn", 9, 16, 0), (2, "night", "night", 27, 32, 0), (3, "39", "39", 24, 26, 1), (3, "at", "", 21, 23, 1),
        (3, "c", "c", 28, 29, 1), (3, "fever", "fever", 35, 40, 0), (3, "headache", "headach", 7, 15, 0), (3, "il6", "il6", 17, 20, 1), (3, "new", "new", 31, 34, 0),
        (3, "severe", "sever", 0, 6, 0), (3, "storm", "storm", 46, 51, 0), (3, "the", "", 42, 45, 0),
    ]),
    "fn_normalize1": ("id bigint, norm1 string", [
        (1, "cytokinestorm"), (2, "fever"), (3, "headache"), (4, "storm"), (5, "night"), (6, "morning"), (7, "severeheadaches"), (8, "ecoli"), (9, "頭痛"),
        (10, "サイトカインstorm"), (11, "theroleofcells"), (12, "il6alphabeta"), (13, "naivet_cells1,234.5"), (14, "feverinmorning"), (15, "morningfever"), (16, "두통fevers"),
        (200, "nightly"), (201, "fevers"),
    ]),
    "fn_normalize2": ("id bigint, norm2 string", [
        (1, "cytokinstorm"), (2, "fever"), (3, "headach"), (4, "storm"), (5, "night"), (6, "morn"), (7, "severheadach"), (8, "ecoli"), (9, "頭痛"), (10, "サイトカインstorm"),
        (11, "rolecell"), (12, "il6alphabeta"), (13, "naivt_cell1,234.5"), (14, "fevermorn"), (15, "mornfever"), (16, "두통fever"), (200, "night"), (201, "fever"),
    ]),
    "fn_sentence_break": ("doc_id bigint, at int", [
        (1, 27), (3, 30), (3, 41),
    ]),
    "fn_paren_level": ("doc_id bigint, n bigint, deepest int", [
        (1, 1, 1), (3, 4, 1),
    ]),
    "fn_norm2_align": ("doc_id bigint, n bigint, n_stopped bigint", [
        (1, 7, 0), (2, 6, 2), (3, 10, 2),
    ]),
    "fn_cross_sentence": ("doc_id bigint, n int", [
        (1, 1), (2, 0), (3, 2),
    ]),
    "fn_normalize_ja": ("id bigint, norm1 string, norm2 string", [
        (9, "頭痛", "頭痛"), (10, "サイトカインstorm", "サイトカインstorm"),
    ]),
    "fn_normalize_ko": ("id bigint, norm1 string, norm2 string", [
        (16, "두통fevers", "두통fever"),
    ]),
    "fn_normalize_str": ("id bigint, label string", [
        (1, "cytokin storm"), (2, "fever"), (3, "headach"), (4, "storm"), (5, "night"), (6, "morn"), (7, "sever headach"), (8, "e. coli"), (9, "頭痛"),
        (10, "サイトカインstorm"), (11, "the role of cell"), (12, "il 6 (alpha beta)"), (13, "naïv t_cell 1,234.5"), (14, "fever in morn"), (15, "morn fever"),
        (16, "두통 fever"), (200, "night"), (201, "fever"),
    ]),
    "fn_abbr_type": ("id bigint, by_initials string, by_identifier string", [
        (1, "regAbbreviation", None), (2, "regAbbreviation", None), (3, "regAbbreviation", None), (4, "regAbbreviation", None), (5, "regAbbreviation", None),
        (6, "regAbbreviation", None), (7, "regAbbreviation", None), (8, "regAbbreviation", None), (9, "regAbbreviation", None), (10, "regAbbreviation", None),
        (11, "regAbbreviation", None), (12, "regAbbreviation", None), (13, "regAbbreviation", None), (14, "regAbbreviation", None), (15, "regAbbreviation", None),
        (16, "regAbbreviation", None), (200, "regAbbreviation", None), (201, "regAbbreviation", None),
    ]),
    "fn_decapitalize": ("id bigint, label string", [
        (1, "cytokine storm"), (2, "fever"), (3, "headache"), (4, "storm"), (5, "night"), (6, "morning"), (7, "severe headaches"), (8, "E. coli"), (9, "頭痛"),
        (10, "サイトカインstorm"), (11, "the role of cells"), (12, "IL-6 (alpha-beta)"), (13, "naïve T_cells 1,234.5"), (14, "fever in morning"), (15, "morning fever"),
        (16, "두통 fevers"), (200, "nightly"), (201, "fevers"),
    ]),
    "fn_simple_tokenize": ("id bigint, piece string, begin int, end int", [
        (1, "Cytokine", 0, 8), (1, "storm", 9, 14), (2, "Fever", 0, 5), (3, "Headache", 0, 8), (4, "storm", 0, 5), (5, "Night", 0, 5), (6, "Morning", 0, 7),
        (7, "Severe", 0, 6), (7, "headaches", 7, 16), (8, ".", 1, 2), (8, "E", 0, 1), (8, "coli", 3, 7), (9, "頭痛", 0, 2), (10, "サイトカインstorm", 0, 11),
        (11, "Cells", 12, 17), (11, "Role", 4, 8), (11, "The", 0, 3), (11, "of", 9, 11), (12, "(", 5, 6), (12, ")", 16, 17), (12, "-", 2, 3), (12, "-", 11, 12),
        (12, "6", 3, 4), (12, "IL", 0, 2), (12, "alpha", 6, 11), (12, "beta", 12, 16), (13, ",", 15, 16), (13, ".", 19, 20), (13, "1", 14, 15), (13, "234", 16, 19),
        (13, "5", 20, 21), (13, "T", 6, 7), (13, "_", 7, 8), (13, "cells", 8, 13), (13, "naïve", 0, 5), (14, "Fever", 0, 5), (14, "in", 6, 8), (14, "morning", 9, 16),
        (15, "fever", 8, 13), (15, "morning", 0, 7), (16, "Fevers", 3, 9), (16, "두통", 0, 2), (200, "nightly", 0, 7), (201, "fevers", 0, 6),
    ]),
    "src_batch_norm": ("label string, norm1 string, norm2 string", [
        ("Cytokine storm", "cytokinestorm", "cytokinstorm"), ("E. coli", "ecoli", "ecoli"), ("Fever", "fever", "fever"),
        ("Fever in morning", "feverinmorning", "fevermorn"), ("Headache", "headache", "headach"), ("IL-6 (alpha-beta)", "il6alphabeta", "il6alphabeta"),
        ("Morning", "morning", "morn"), ("Night", "night", "night"), ("Severe headaches", "severeheadaches", "severheadach"),
        ("The Role of Cells", "theroleofcells", "rolecell"), ("fevers", "fevers", "fever"), ("morning fever", "morningfever", "mornfever"),
        ("naïve T_cells 1,234.5", "naivet_cells1,234.5", "naivt_cell1,234.5"), ("nightly", "nightly", "night"), ("storm", "storm", "storm"),
        ("サイトカインstorm", "サイトカインstorm", "サイトカインstorm"), ("頭痛", "頭痛", "頭痛"), ("두통 Fevers", "두통fevers", "두통fever"),
    ]),
    "ann_spans": ("doc_id bigint, begin int, end int, span string, norm1 string, norm2 string", [
        (1, 2, 10, "cytokine", "cytokine", "cytokin"), (1, 2, 16, "cytokine storm", "cytokinestorm", "cytokinstorm"),
        (1, 2, 21, "cytokine storm (CS)", "cytokinestormcs", "cytokinstormcs"), (1, 2, 26, "cytokine storm (CS) came", "cytokinestormcscame", "cytokinstormcscame"),
        (1, 11, 16, "storm", "storm", "storm"), (1, 11, 21, "storm (CS)", "stormcs", "stormcs"), (1, 11, 26, "storm (CS) came", "stormcscame", "stormcscame"),
        (1, 17, 26, "(CS) came", "cscame", "cscame"), (1, 18, 20, "CS", "cs", "cs"), (1, 22, 26, "came", "came", "came"), (1, 28, 30, "CS", "cs", "cs"),
        (1, 28, 35, "CS left", "csleft", "csleft"), (1, 31, 35, "left", "left", "left"), (2, 0, 5, "Fever", "fever", "fever"),
        (2, 0, 16, "Fever in morning", "feverinmorning", "fevermorn"), (2, 0, 23, "Fever in morning, fever", "feverinmorningfever", "fevermornfever"),
        (2, 9, 16, "morning", "morning", "morn"), (2, 9, 23, "morning, fever", "morningfever", "mornfever"),
        (2, 9, 32, "morning, fever at night", "morningfeveratnight", "mornfevernight"), (2, 18, 23, "fever", "fever", "fever"),
        (2, 18, 32, "fever at night", "feveratnight", "fevernight"), (2, 27, 32, "night", "night", "night"), (3, 0, 6, "Severe", "severe", "sever"),
        (3, 0, 15, "Severe headache", "severeheadache", "severheadach"), (3, 7, 15, "headache", "headache", "headach"), (3, 17, 20, "IL6", "il6", "il6"),
        (3, 17, 26, "IL6 at 39", "il6at39", "il639"), (3, 17, 29, "IL6 at 39 °C", "il6at39c", "il639c"), (3, 24, 26, "39", "39", "39"),
        (3, 24, 29, "39 °C", "39c", "39c"), (3, 28, 29, "C", "c", "c"), (3, 31, 34, "New", "new", "new"), (3, 31, 40, "New fever", "newfever", "newfever"),
        (3, 35, 40, "fever", "fever", "fever"), (3, 46, 51, "Storm", "storm", "storm"),
    ]),
    "ann_surface": ("span string, dictionary_id bigint, identifier string, label string, score double", [
        ("Fever", 1, "HP:0001945", "Fever", 1.0), ("Fever in morning", 1, "X:7", "Fever in morning", 1.0),
        ("Severe headache", 1, "HP:0002315", "Severe headaches", 0.961227), ("Storm", 1, "X:1", "storm", 0.9375),
        ("cytokine storm", 1, "HP:0033041", "Cytokine storm", 0.970588), ("fever", 1, "HP:0001945", "Fever", 0.9375),
        ("headache", 1, "HP:0002315", "Headache", 0.954545), ("morning, fever", 1, "X:8", "morning fever", 0.973958), ("storm", 1, "X:1", "storm", 1.0),
    ]),
    "ann_denotations": ("doc_id bigint, begin int, end int, obj string, score double", [
        (1, 2, 16, "HP:0033041", 0.970588), (1, 11, 16, "X:1", 1.0), (2, 0, 5, "HP:0001945", 1.0), (2, 0, 16, "X:7", 1.0), (2, 9, 23, "X:8", 0.973958),
        (2, 18, 23, "HP:0001945", 0.9375), (3, 0, 15, "HP:0002315", 0.961227), (3, 7, 15, "HP:0002315", 0.954545), (3, 17, 20, "GENE", 1.0),
        (3, 24, 29, "TEMPERATURE", 1.0), (3, 35, 40, "HP:0001945", 0.9375), (3, 46, 51, "X:1", 0.9375),
    ]),
    "ann_sort": "ann_denotations",
    "srt_denotations": "ann_denotations",
    "ann_consolidate": ("doc_id bigint, begin int, end int, obj string, score double", [
        (1, 2, 16, "HP:0033041", 0.970588), (1, 11, 16, "X:1", 1.0), (2, 0, 5, "HP:0001945", 1.0), (2, 0, 16, "X:7", 1.0), (2, 9, 23, "X:8", 0.973958),
        (2, 18, 23, "HP:0001945", 0.9375), (3, 0, 15, "HP:0002315", 0.961227), (3, 17, 20, "GENE", 1.0), (3, 24, 29, "TEMPERATURE", 1.0),
        (3, 35, 40, "HP:0001945", 0.9375), (3, 46, 51, "X:1", 0.9375),
    ]),
    "ann_boundary": ("doc_id bigint, begin int, end int, obj string, score double", [
        (1, 2, 16, "HP:0033041", 0.970588), (1, 11, 16, "X:1", 1.0), (2, 0, 5, "HP:0001945", 1.0), (2, 0, 16, "X:7", 1.0), (2, 18, 23, "HP:0001945", 0.9375),
        (3, 0, 15, "HP:0002315", 0.961227), (3, 17, 20, "GENE", 1.0), (3, 24, 29, "TEMPERATURE", 1.0), (3, 35, 40, "HP:0001945", 0.9375), (3, 46, 51, "X:1", 0.9375),
    ]),
    "ann_embedded": ("doc_id bigint, begin int, end int, obj string, score double", [
        (1, 2, 16, "HP:0033041", 0.970588), (2, 0, 16, "X:7", 1.0), (2, 18, 23, "HP:0001945", 0.9375), (3, 0, 15, "HP:0002315", 0.961227), (3, 17, 20, "GENE", 1.0),
        (3, 24, 29, "TEMPERATURE", 1.0), (3, 35, 40, "HP:0001945", 0.9375), (3, 46, 51, "X:1", 0.9375),
    ]),
    "ann_abbr_find": ("string string, obj string, abbr_type string", [
        ("CS", "HP:0033041", "regAbbreviation"),
    ]),
    "ann_abbr_emit": ("doc_id bigint, begin int, end int, obj string, abbr_type string", [
        (1, 18, 20, "HP:0033041", "regAbbreviation"), (1, 28, 30, "HP:0033041", "regAbbreviation"),
    ]),
    "ann_reset": ("doc_id bigint, n bigint", [
        (1, 1), (2, 2), (3, 3),
    ]),
    "join_interval_overlap": ("doc_id bigint, n bigint", [
        (1, 1), (2, 3), (3, 1),
    ]),
    "op_annotation_batch": ("doc_id bigint, begin int, end int, obj string, score double, abbr_type string, string string, label string, norm1 string, norm2 string", [
        (1, 2, 16, "HP:0033041", 0.970588, None, "cytokine storm", None, None, None), (1, 18, 20, "HP:0033041", None, "regAbbreviation", "CS", None, None, None),
        (1, 28, 30, "HP:0033041", None, "regAbbreviation", "CS", None, None, None), (2, 0, 16, "X:7", 1.0, None, "Fever in morning", None, None, None),
        (2, 18, 23, "HP:0001945", 0.9375, None, "fever", None, None, None), (3, 0, 15, "HP:0002315", 0.961227, None, "Severe headache", None, None, None),
        (3, 35, 40, "HP:0001945", 0.9375, None, "fever", None, None, None), (3, 46, 51, "X:1", 0.9375, None, "Storm", None, None, None),
    ]),
    "ann_superfluous": ("doc_id bigint, begin int, end int, obj string, score double, abbr_type string, string string, label string, norm1 string, norm2 string", [
        (1, 2, 16, "HP:0033041", 0.970588, None, "cytokine storm", None, None, None), (1, 11, 16, "X:1", 1.0, None, "storm", None, None, None),
        (1, 18, 20, "HP:0033041", None, "regAbbreviation", "CS", None, None, None), (1, 28, 30, "HP:0033041", None, "regAbbreviation", "CS", None, None, None),
        (2, 0, 5, "HP:0001945", 1.0, None, "Fever", None, None, None), (2, 0, 16, "X:7", 1.0, None, "Fever in morning", None, None, None),
        (2, 18, 23, "HP:0001945", 0.9375, None, "fever", None, None, None), (3, 0, 15, "HP:0002315", 0.961227, None, "Severe headache", None, None, None),
        (3, 35, 40, "HP:0001945", 0.9375, None, "fever", None, None, None), (3, 46, 51, "X:1", 0.9375, None, "Storm", None, None, None),
    ]),
    "ann_verbose_exact": ("doc_id bigint, begin int, end int, obj string, score double, abbr_type string, string string, label string, norm1 string, norm2 string", [
        (1, 11, 16, "X:1", 1.0, None, "storm", "storm", "storm", "storm"),
        (2, 0, 16, "X:7", 1.0, None, "Fever in morning", "Fever in morning", "feverinmorning", "fevermorn"),
    ]),
    "ann_with_patterns": ("doc_id bigint, begin int, end int, obj string, score double, abbr_type string, string string, label string, norm1 string, norm2 string", [
        (1, 2, 16, "HP:0033041", 0.970588, None, "cytokine storm", None, None, None), (1, 18, 20, "HP:0033041", None, "regAbbreviation", "CS", None, None, None),
        (1, 28, 30, "HP:0033041", None, "regAbbreviation", "CS", None, None, None), (2, 0, 16, "X:7", 1.0, None, "Fever in morning", None, None, None),
        (2, 18, 23, "HP:0001945", 0.9375, None, "fever", None, None, None), (3, 0, 15, "HP:0002315", 0.961227, None, "Severe headache", None, None, None),
        (3, 17, 20, "GENE", 1.0, None, "IL6", None, None, None), (3, 24, 29, "TEMPERATURE", 1.0, None, "39 °C", None, None, None),
        (3, 35, 40, "HP:0001945", 0.9375, None, "fever", None, None, None), (3, 46, 51, "X:1", 0.9375, None, "Storm", None, None, None),
    ]),
    "ann_patterns": ("doc_id bigint, begin int, end int, obj string, string string", [
        (3, 17, 20, "GENE", "IL6"), (3, 24, 29, "TEMPERATURE", "39 °C"),
    ]),
    "ann_context_filter": ("doc_id bigint, n_dictionaries bigint", [
        (1, 4), (2, 4), (3, 3),
    ]),
    "ann_semantic": ("span string, dictionary_id bigint, identifier string, score double", [
        ("Fever", 17, "O:2", 0.668153), ("Fever in morning, fever", 17, "O:2", 0.553912), ("New fever", 17, "O:2", 0.533002), ("fever", 17, "O:2", 0.668153),
        ("fever at night", 17, "O:2", 0.53033), ("night", 16, "N:0", 0.668153), ("night", 16, "N:1", 0.668153), ("night", 16, "N:2", 0.668153),
        ("night", 16, "N:3", 0.668153), ("night", 16, "N:4", 0.668153), ("night", 16, "N:5", 0.668153), ("night", 16, "N:6", 0.668153), ("night", 16, "N:7", 0.668153),
        ("night", 16, "N:8", 0.668153), ("night", 16, "N:9", 0.668153), ("night", 17, "O:1", 0.629941),
    ]),
    "ann_combine": ("span string, dictionary_id bigint, identifier string, score double", [
        ("Fever", 1, "HP:0001945", 1.0), ("Fever in morning", 1, "X:7", 1.0), ("Fever in morning, fever", 17, "O:2", 0.553912), ("New fever", 17, "O:2", 0.533002),
        ("Severe headache", 1, "HP:0002315", 0.961227), ("Storm", 1, "X:1", 0.9375), ("cytokine storm", 1, "HP:0033041", 0.970588), ("fever", 1, "HP:0001945", 0.9375),
        ("fever at night", 17, "O:2", 0.53033), ("headache", 1, "HP:0002315", 0.954545), ("morning, fever", 1, "X:8", 0.973958), ("night", 16, "N:0", 0.668153),
        ("night", 16, "N:1", 0.668153), ("night", 16, "N:2", 0.668153), ("night", 16, "N:3", 0.668153), ("night", 16, "N:4", 0.668153), ("night", 16, "N:5", 0.668153),
        ("night", 16, "N:6", 0.668153), ("night", 16, "N:7", 0.668153), ("night", 16, "N:8", 0.668153), ("night", 16, "N:9", 0.668153), ("storm", 1, "X:1", 1.0),
    ]),
    "snk_json_result": ("doc_id bigint, begin int, end int, obj string", [
        (1, 11, 16, "X:1"), (2, 0, 16, "X:7"),
    ]),
    "ann_matches_by_dictionary": ("dictionary_id bigint, n_spans bigint", [
        (1, 9),
    ]),
}
PARAMETERS = [(1, "true", "true", " 12 ", "0.85", "a, b|c\n\nd"), (2, None, "1", "x", "", None), (3, "yes", "0", None, "1e-2", " , ")]
PARSED = ("id bigint, flag boolean, flag_or_true boolean, whole bigint, part double, list string", [(1, True, True, 12, 0.85, "a+b+c+d"), (2, False, True, None, None, ""), (3, False, False, None, 0.01, "")])


def parsed_parameters(s: SparkSession, d: str) -> DataFrame:
    """Request parameters of three requests as typed values."""
    from termforge.operators.params import to_array, to_boolean, to_float, to_integer

    rows = [(i, to_boolean(a), to_boolean(b, True), to_integer(c), to_float(x), "+".join(to_array(y))) for i, a, b, c, x, y in PARAMETERS]
    return s.createDataFrame(rows, PARSED[0])


def answers(s: SparkSession, d: str) -> DataFrame:
    """What the agents' tools say about the little folder."""
    import json

    from termforge.engine import Engine
    from termforge.sources.tables import table
    from termforge.tools import respond

    at = folder(s)
    none = s.createDataFrame([], "entry_id long, tag_id long"), s.createDataFrame([], "id long, dictionary_id long, value string")
    engine = Engine(table(s, at, "entries"), table(s, at, "dictionaries").withColumn("description", F.concat(F.lit("of "), "name")), *none)
    calls = [
        ("find_ids", {"labels": "fever,none", "dictionary": "clinical"}), ("find_terms", {"ids": "X:1,NO:1", "dictionary": "clinical"}), ("get_dictionary_description", {"name": "species"}),
        ("find_terms", {"ids": "X:1"}), ("other", {}),
    ]
    said = [respond(engine, json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": n, "arguments": x}})) for i, (n, x) in enumerate(calls)]
    rows = [(r["id"], r["result"]["content"][0]["text"].replace("\n", "|"), r["result"].get("isError", False)) for r in said]
    return s.createDataFrame(rows, ANSWERS[0])


ANSWERS = ("id bigint, text string, failed boolean", [
    (0, 'Found identifiers for terms in dictionary "clinical":||**fever**: HP:0001945|**none**: ', False),
    (1, 'Found terms for identifiers in dictionary "clinical":||**X:1**: storm (from clinical)', False),
    (2, 'Description for dictionary "species":||of species', False), (3, "Error: Dictionary name is required", True), (4, "Error: Unknown tool: other", True),
])
KINDS = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _sql(columns: str, rows: list[tuple]) -> str:
    names, kinds = zip(*(c.split(" ") for c in columns.split(", ")))
    literal = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    casts = ", ".join(f'CAST("{n}" AS {KINDS[k]}) AS "{n}"' for n, k in zip(names, kinds))
    quoted = ", ".join(f'"{n}"' for n in names)
    return f"SELECT {casts} FROM (VALUES {values}) AS t({quoted})"


def _over_folder(run):
    def golden(s: SparkSession, d: str) -> DataFrame:
        df = run(s, folder(s))
        return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])

    return golden


def golden(whole: dict) -> tuple[dict, dict[str, str], set[str]]:
    """Queries and SQL by name, made of the queries over all documents, and the names that those must give up."""
    queries, sql, taken = {}, {}, set()
    for name, shown in ROWS.items():
        columns, rows = ROWS[shown] if isinstance(shown, str) else shown
        at = name if name not in KEPT else f"{name}_golden"
        queries[at], sql[at] = _over_folder(whole[name]), _sql(columns, rows)
        if name not in KEPT:
            taken.add(name)
    queries |= {"fn_param_parsers": parsed_parameters, "op_mcp_tools": answers}
    sql |= {"fn_param_parsers": _sql(*PARSED), "op_mcp_tools": _sql(*ANSWERS)}
    return queries, sql, taken


#: Names that stay with the query over all documents, which is timed.
KEPT = {"op_annotation_batch"}
