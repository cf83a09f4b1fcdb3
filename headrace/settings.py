"""Fixed values of the forecasting task.

Every constant here must hold for results to agree with the published ones.
"""

# Cleaning thresholds.
NEAR_ZERO = 0.05
SPIKE_FACTOR = 3.5
SHORT_GAP = 2
SHORT_ZERO_RUN = 2
KNN_NEIGHBOURS = 5

# Feature offsets, in hours.
LAGS = [1, 2, 3, 6, 12, 24, 48, 72, 168]
ROLL_WINDOWS = [3, 6, 12, 24, 48, 168]
HYDRO_LAGS = [1, 3, 6, 12, 24]
DIFFS = [1, 3, 24]

# Chronological split.
TRAIN_RATIO = 0.70
VALIDATION_RATIO = 0.15
HISTORY_HOURS = 240
HORIZON = 24
SELECTION_DAYS = 12

# Calibration grids.
SHRINKAGE_GRID = [0.05, 0.10, 0.20, 0.35, 0.50, 0.75, 1.00, 1.15]
BIN_QUANTILES = list(range(3, 21))
BIN_QUANTILES_WIDE = list(range(3, 41))
BIN_SCALES = [round(0.50 + 0.05 * i, 2) for i in range(41)]
HOURLY_SCALES = [0.0, 0.25, 0.50, 0.75, 1.00, 1.25]
PROFILE_WEIGHTS = [0.0, 0.10, 0.20, 0.30, 0.40, 0.55, 0.70, 0.85]
ANCHOR_WEIGHTS = [0.0, 0.25, 0.50, 0.75, 1.00]
ANCHOR_WEIGHT_CAP = 0.85
SAVED_BLEND_WEIGHTS = [round(0.05 * i, 2) for i in range(1, 19)]
HOURLY_CLIP_SHARE = 0.08
CAPACITY_HEADROOM = 1.05
RAMP_QUANTILE = 0.98
RAMP_DEFAULT = 2.0

# Candidate scoring.
R2_WEIGHT_PRIMARY = 20.0
R2_WEIGHT_RIVAL = 8.0
NEGATIVE_R2_PENALTY = 25.0
FINALISTS_PRIMARY = 10
FINALISTS_RIVAL = 3
LOW_LOAD_FRACTION = 0.40

# Unit allocation: weight of the current share, of the median of the last 168
# hours and of the median of the last 56 same-hour shares.
SHARE_WEIGHTS = (0.50, 0.35, 0.15)
RECENT_SHARE_HOURS = 168
SAME_HOUR_SHARES = 56

# Names that must never appear among model inputs.
FORBIDDEN_FEATURES = [
    r"_tplus1$",
    r"_delta_tplus1$",
    r"actual",
    r"predicted",
    r"forecast",
    r"testing",
    r"validation",
]

# Search space of the radial-basis model: (centers, learning rate, gamma,
# batch size, patience).
RBF_BASE_CONFIGS = [
    (40, 0.0012, 1.0, 32, 8),
    (60, 0.0010, 1.0, 32, 8),
    (60, 0.0005, 0.5, 16, 16),
    (80, 0.0010, 0.5, 32, 12),
    (80, 0.0007, 2.0, 16, 12),
    (120, 0.0010, 1.0, 32, 12),
    (120, 0.0007, 0.5, 16, 16),
    (120, 0.0005, 2.0, 32, 16),
    (160, 0.0005, 1.0, 32, 16),
    (180, 0.0005, 1.0, 32, 16),
    (180, 0.0003, 0.5, 16, 16),
    (220, 0.0002, 0.5, 16, 20),
]

# Further points by place of the site in the cascade.
RBF_EXTRA_CONFIGS = {
    1: [
        (60, 0.0007, 2.0, 16, 12),
        (80, 0.0003, 1.0, 16, 20),
        (120, 0.0002, 0.5, 16, 24),
        (160, 0.0003, 1.0, 16, 20),
        (220, 0.0002, 1.0, 16, 24),
    ],
    2: [
        (40, 0.0007, 2.0, 16, 16),
        (60, 0.0003, 1.0, 16, 20),
        (80, 0.0002, 0.5, 16, 24),
        (120, 0.0002, 1.0, 16, 24),
        (160, 0.0003, 0.5, 16, 20),
        (220, 0.0002, 2.0, 16, 24),
    ],
    3: [
        (80, 0.0003, 2.0, 16, 20),
        (120, 0.0002, 0.5, 16, 24),
        (160, 0.0007, 1.0, 32, 16),
        (180, 0.0002, 1.0, 16, 24),
        (220, 0.0003, 1.0, 16, 20),
        (260, 0.0002, 0.5, 16, 24),
    ],
    4: [
        (80, 0.0005, 0.5, 16, 16),
        (120, 0.0003, 1.0, 16, 16),
        (220, 0.0002, 1.0, 16, 20),
    ],
    5: [
        (180, 0.0007, 0.5, 32, 16),
        (220, 0.0003, 0.5, 16, 20),
    ],
    6: [
        (80, 0.0005, 1.0, 16, 16),
        (120, 0.0003, 0.5, 16, 16),
        (160, 0.0002, 1.0, 16, 20),
    ],
}

# Random forest: (trees, depth, minimum leaf rows, feature share).
FOREST_CONFIGS = [
    (240, 8, 6, "sqrt"),
    (300, 12, 4, "0.55"),
    (360, 18, 2, "0.75"),
    (420, None, 3, "0.85"),
]

# Further forest points by place of the site in the cascade.
FOREST_EXTRA_CONFIGS = {
    2: [
        (300, 6, 10, "sqrt"),
        (360, 10, 12, "0.40"),
    ],
}

# Boosted trees: (rounds, learning rate, depth, row share, column share, L2).
BOOSTING_CONFIGS = [
    (260, 0.05, 3, 0.95, 0.95, 1.0),
    (420, 0.035, 3, 0.90, 0.90, 1.0),
    (560, 0.025, 4, 0.88, 0.85, 1.5),
    (720, 0.018, 4, 0.85, 0.80, 2.0),
]
