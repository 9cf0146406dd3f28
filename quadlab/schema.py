"""Canonical table schemas (DDL)."""

SAMPLES = "split string, name string, stem string, prefix string, is_negative boolean"
LABELS = "stem string, class int, coords array<double>, n_lines bigint"
PREDICTIONS = "split string, source string, name string, detected int, conf double, coords array<double>"
IMAGES = "stem string, ext string, dir string"
EVALS = "split string, name string, iou double, err_mean double, err_max double, score double"
REVIEW = "name string, action string, coords array<double>, seq bigint"

# Lookup order of split variants and image extensions.
SPLIT_VARIANTS = ["_with_negative_v2", "_with_negative", ""]
SPLIT_VARIANTS_PLAIN_FIRST = ["", "_with_negative_v2", "_with_negative"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".JPG", ".JPEG", ".PNG"]
SOURCES = ["teacher", "winner", "docaligner"]
