"""hatefold: toxic-text dataset, augmentation and evaluation jobs on Spark.

The operators take and return DataFrames; see README.md for the coverage map.
"""

import sys as _sys

# Worker-side Python (the trainer's mapInPandas, the Arrow scoring step) ships
# with its closures: functions of this package are pickled by value, so the
# executors need no installed copy of it (on a cluster, --py-files also works).
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to shipping the package
    pass

from .operators.augment import augment, augment_corpus, build_training_set, with_variants
from .operators.features import char_ngrams, encode_text, hashed_features, term_vocabulary
from .operators.history import best_epoch, best_run, early_stop, epoch_train_loss
from .operators.labels import (add_missing_labels, class_filter, coarse_encode, collapse_labels,
                               crosswalk_labels, harmonize_columns, mapping_frame, pack_fine, preview,
                               project_corpus, skip_blank, training_source, union_corpora,
                               value_distribution)
from .operators.lexicon import (LEXICON_SCHEMA, clean_terms, explode_matches, looks_like_insult,
                                match_lexicon, merge_lexicon, mine_terms, prepare_matcher)
from .operators.metrics import (class_weights, coarse_metrics, confusion, confusion_matrix,
                                consistency_penalty, fine_metrics, losses, pos_weights,
                                single_label_metrics)
from .operators.ranking import numbered
from .operators.score import compare_predictions, suspect, two_head_record
from .operators.split import stratified_split
from .operators.train import evaluate_two_head, fit_baseline, fit_two_head, fit_two_heads, score_two_head
from .session import get_spark
from .sources.io import (convert_tsv, read_lexicon, read_posts_csv, read_term_freq, read_term_freq_lines,
                         read_tsv, write_lexicon, write_table)
from .streaming.chat_filter import filter_messages, run_chat_filter

__all__ = [n for n in dir() if not n.startswith("_")]
