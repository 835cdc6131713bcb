"""Values and conventions shared by every operator.

Spread is always the population standard deviation, thresholds are strict
(``>``), percentiles interpolate linearly, the last histogram bin is closed,
split sizes are floored and the first row wins on ties.
"""

# File-name codes of the four modalities and their display names.
MODALITY_NAMES = {"t1c": "T1ce", "t1n": "T1n", "t2f": "FLAIR", "2w": "T2w", "t2w": "T2w"}

# Fixed value: file-name code of segmentations.
SEGMENTATION_CODE = "seg"

# Display names of the segmentation labels.
LABEL_NAMES = {
    1: "edema (ET)",
    2: "non-enhancing core (NCR)",
    3: "enhancing core (ET)",
    4: "whole tumor (WST)",
}

# Overlapping regions as lists of labels.  The exploratory
# analysis reads label 4 as the whole tumour, preprocessing unites 1, 2 and 3.
REGION_PRESETS = {
    "eda": {
        "tumor_core": [2, 3],
        "whole_tumor": [4],
        "edema_only": [1],
        "enhancing_only": [3],
    },
    "preproc": {"et": [3], "tc": [2, 3], "wt": [1, 2, 3]},
}

# Numeric constants of the normalisation and scoring rules.
EPSILON = 1e-8
MASK_THRESHOLD = 50.0
CLIP_PERCENTILE = 0.995
LOG_VOLUME_SCALE = 12.0
VOXEL_SPACING = (1.0, 1.0, 1.0)
EFFECTIVE_NUMBER_BETA = 0.999

# Naming rules of cases and scan files.
PATIENT_PATTERN = r"BraTS-GLI-(\d+)-"
SEQUENCE_PATTERN = r"-(\d{3})$"
MODALITY_PATTERN = r"-([^-]+)\.nii\.gz$"
CLASS_FOLDER_PATTERN = r"/(train|val|test)/(\d+)/[^/]+\.nii\.gz$"
_NUMBER = r"([-+]?(?:\d[\d.]*(?:e[-+]?\d+)?|nan|inf))"
EPOCH_LINE_PATTERNS = (
    rf"(?i)Epoch +(\d+) \| Train: loss={_NUMBER} acc={_NUMBER} \| Val: loss={_NUMBER} acc={_NUMBER}",
    rf"(?i)Epoch +(\d+)/\d+ \| train_loss={_NUMBER} train_acc={_NUMBER} \| val_loss={_NUMBER} val_acc={_NUMBER}",
)
LOG_TIME_PATTERN = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3})"
