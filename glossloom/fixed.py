"""Word lists, index tables and patterns that decide the results."""

# Spellings that are merged by the label normaliser.
LABEL_ALIASES = {
    "thankyou": "thank you",
    "goodmorning": "good morning",
    "goodnight": "good night",
    "howareyou": "how are you",
}

# The default target words.
TARGET_WORDS = ("eat", "go", "hello", "help", "no", "please", "water", "yes")

# Folder names that never name a label.
GENERIC_FOLDERS = (
    "videos", "video", "train", "test", "val", "validation", "data", "raw", "extracted",
    "include", "mp4", "mov", "greetings", "adjectives", "animals", "clothes", "colours",
    "colors", "home", "jobs", "people", "places", "pronouns", "seasons", "society",
    "electronics", "days_and_time", "means_of_transportation",
)

# Video file endings of clip folders and of corpus trees.
CLIP_ENDINGS = ("mp4", "mov", "avi", "mkv", "webm", "mts")
CORPUS_ENDINGS = ("mp4", "mov", "avi", "mkv", "webm", "mpg", "mpeg", "m4v", "wmv")

# Corpus folder prefix and source names with their own rules.
CORPUS_FOLDER = "ISL_DATASET"
DICTIONARY_SOURCE = "ISLRTC"
DICTIONARY_SIGNER = "islrtc"
SESSION_SOURCE = "ISL500"
COUNTER_SOURCE = "include"
COMPETITION_SOURCE = "gislr"

# Columns of a clip index.
INDEX_COLUMNS = (
    "key", "word", "source", "signer", "session", "split", "n_frames", "fps",
    "path", "video_rel", "license",
)

# Columns of a corpus record.
RECORD_COLUMNS = (
    "word", "normalized_word", "dataset", "original_label", "video_path", "original_filename",
    "signer", "split", "fps", "resolution", "duration", "license", "paper", "repository",
    "download_url", "sha256", "phash", "quality_score", "duplicate_status", "review_status",
)

# Point counts of one frame, in storage order pose, left hand, right hand, face.
N_POSE, N_HAND, N_FACE = 33, 21, 468
N_POINTS = N_POSE + 2 * N_HAND + N_FACE
LAYOUT_TAG = "holistic_pose_lh_rh_face_v1"

# Face points kept in the reduced view (lips, then nose).
LIP_POINTS = (
    61, 185, 40, 39, 37, 0, 267, 269, 270, 409, 291,
    146, 91, 181, 84, 17, 314, 405, 321, 375,
    78, 191, 80, 81, 82, 13, 312, 311, 310, 415, 308,
    95, 88, 178, 87, 14, 317, 402, 318, 324,
)
NOSE_POINTS = (1, 2, 98, 327)

# Joints of the 27-point skeleton, and body points of the part view.
POSE_JOINTS = (0, 11, 12, 13, 14, 15, 16)
HAND_JOINTS = (0, 4, 5, 8, 9, 12, 13, 16, 17, 20)
BODY_POINTS = (0, 11, 12, 13, 14, 15, 16, 23, 24)

# Edges of the 27-point skeleton (arms and shoulders, wrist links, left hand, right hand).
SKELETON_EDGES = (
    (0, 1), (0, 2), (1, 2), (1, 3), (3, 5), (2, 4), (4, 6),
    (5, 7), (6, 17),
    (7, 8), (7, 9), (7, 11), (7, 13), (7, 15), (9, 10), (11, 12), (13, 14), (15, 16), (9, 11), (11, 13), (13, 15),
    (17, 18), (17, 19), (17, 21), (17, 23), (17, 25), (19, 20), (21, 22), (23, 24), (25, 26), (19, 21), (21, 23), (23, 25),
)

# Default shots, least clips of a word, and limits of a test side.
SHOTS, LEAST_CLIPS = 4, 3
TEST_LIMITS = {"frac": 0.25, "min_test": 2, "max_test": 20, "max_frac": 0.5}

# Session and sampling constants.
SESSION_GAP = 200
MAX_FRAMES = 256
TARGET_FPS = 15
MODEL_FRAMES = 30

# Smoothing and decomposition constants.
KALMAN_Q, KALMAN_R = 8e-4, 1.5e-2
DMD_DELAYS, DMD_MODES = 8, 3

# Planning seconds per step by model, the fallback and the job overhead.
STEP_SECONDS = {
    "mp_bilstm": 0.010, "mp_transformer": 0.010, "fft_bilstm": 0.012, "cwt_bilstm": 0.014,
    "cwt_transformer": 0.012, "stgcn": 0.030, "ctr_gcn": 0.060, "td_gcn": 0.080, "hwgat": 0.030,
    "pgf_slr": 0.045, "kdf_transformer": 0.015, "mp_transformer_reg": 0.012,
    "kdf_transformer_nodmd": 0.014, "kdf_transformer_nokc": 0.014, "partformer": 0.020,
    "partformer_cos": 0.020, "conv1d_former": 0.020, "kdf_partformer": 0.024, "cnn_bilstm": 0.25,
}
DEFAULT_STEP_SECONDS = 0.03
JOB_OVERHEAD_SECONDS = 15.0

# Label bridges that need a manual review.
REVIEW_ALIASES = {"i": "me", "house": "home", "alright": "okay"}

# Model name aliases.
MODEL_ALIASES = {"kdf_stgcn": "kdf_transformer"}
