"""Benchmark configuration as plain tables."""

# Score floors a metric must reach, per metric.
METRIC_FLOORS = {
    "r_precision": 0.001, "r_recall": 0.001, "ws_precision": 0.5, "ws_recall": 0.5, "vc": 0.01, "sem": 0.01,
    "t_rec_precision": 2.0, "t_rec_recall": 2.0, "replicate_consistency": 0.3, "tfb_f1": 0.05, "gs_f1": 0.05,
}
DEFAULT_FLOOR = 0.1

# Score columns that each metric family fills.
FAMILY_METRICS = {
    "regression": ["r_precision", "r_recall"], "ws_distance": ["ws_precision", "ws_recall"],
    "tf_recovery": ["t_rec_precision", "t_rec_recall"], "tf_binding": ["tfb_f1"], "sem": ["sem"],
    "gs_recovery": ["gs_f1"], "vc": ["vc"], "replicate_consistency": ["replicate_consistency"],
}

# Metric families that apply to each dataset.
DATASET_FAMILIES = {
    "replogle": ["regression", "ws_distance", "tf_recovery", "tf_binding", "sem", "gs_recovery", "vc"],
    "norman": ["regression", "ws_distance", "tf_binding", "gs_recovery", "vc", "tf_recovery"],
    "nakatake": ["regression", "gs_recovery", "vc"],
    "op": ["regression", "vc", "replicate_consistency", "tf_binding", "sem", "gs_recovery"],
    "300BCG": ["regression", "vc", "replicate_consistency", "tf_binding", "gs_recovery"],
    "parsebioscience": ["regression", "vc", "replicate_consistency", "tf_binding", "sem", "gs_recovery"],
    "xaira_HEK293T": ["regression", "ws_distance", "tf_recovery", "tf_binding", "sem", "gs_recovery", "vc"],
    "xaira_HCT116": ["regression", "ws_distance", "tf_recovery", "tf_binding", "sem", "gs_recovery", "vc"],
    "MSCIC": ["regression", "gs_recovery", "replicate_consistency"],
    "soundlife": ["regression", "replicate_consistency", "tf_binding", "gs_recovery"],
    "soundlife_vaccine": ["regression", "replicate_consistency", "tf_binding", "gs_recovery"],
}

# Metadata columns for control matching, folds, anchors and replicate groups.
DATASET_GROUPS = {
    "op": {"match": ["plate_name", "donor_id", "cell_type", "well"], "loose_match": ["plate_name", "donor_id", "cell_type"],
           "anchors": ["donor_id", "plate_name"], "cv": ["perturbation", "cell_type"], "replicates": ["perturbation", "cell_type"]},
    "parsebioscience": {"match": ["donor_id", "cell_type", "well"], "loose_match": ["donor_id", "cell_type"],
                        "anchors": ["donor_id"], "cv": ["perturbation", "cell_type"], "replicates": ["perturbation", "cell_type"]},
    "300BCG": {"match": ["donor_id", "cell_type"], "loose_match": ["cell_type"], "anchors": ["donor_id"],
               "cv": ["perturbation", "cell_type"], "replicates": ["perturbation", "cell_type"]},
    **{d: {"match": ["perturbation"], "loose_match": ["perturbation"], "cv": ["perturbation"]}
       for d in ("replogle", "xaira_HEK293T", "xaira_HCT116", "nakatake", "norman")},
    **{d: {"replicates": ["cell_type"]} for d in ("MSCIC", "soundlife", "soundlife_vaccine")},
}

# Fold column of datasets without perturbations.
CV_COLUMN = {"MSCIC": "donor_id", "soundlife": "donor_id", "soundlife_vaccine": "donor_id"}

# Datasets with both modalities; all others are transcriptomic.
MULTIOMICS = ["op", "MSCIC"]


def modality(dataset):
    return "Multiomics" if dataset in MULTIOMICS else "Transcriptomics"
