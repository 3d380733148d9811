"""Default vocabularies. All of them are arguments of the operators that use them."""

from __future__ import annotations

# Entity terms by type.
ENTITY_TERMS = {
    "METHOD": [
        "dynamic bayesian network", "bayesian network", "bayesian belief network", "causal model",
        "regression model", "random forest", "support vector machine", "neural network",
        "convolutional neural network", "generative adversarial network", "transformer", "decision tree",
        "k-means", "principal component analysis", "linear programming",
    ],
    "DATASET": [
        "cifar-10", "cifar-100", "imagenet", "mnist", "coco", "pascal voc", "squad", "glue", "conll", "imdb",
    ],
    "METRIC": [
        "linear correlation coefficient", "correlation coefficient", "correlation", "prediction inaccuracy",
        "inaccuracy", "accuracy", "precision", "recall", "f1 score", "f1", "auc", "roc", "rmse", "mae", "mse",
        "perplexity",
    ],
    "TOOL": [
        "AgenaRisk", "AID", "TensorFlow", "PyTorch", "Scikit-learn", "MATLAB", "SPSS", "Docker", "Kubernetes",
    ],
    "ORG": [
        "Philips Consumer Electronics", "Philips", "Queen Mary University of London", "QinetiQ",
        "Israel Aircraft Industries",
    ],
    "CONCEPT": [
        "software defect prediction", "defect prediction", "residual defects", "defect insertion",
        "defect detection", "testing and rework", "testing process quality", "software lifecycle",
        "lifecycle phase", "quality indicators", "expert judgement", "causal modelling",
        "probability distribution", "decision support system",
    ],
}

# Phrases that signal a kind of claim.
SIGNALS = {
    "problem": [
        "problem", "challenge", "limitation", "lack of", "difficulty", "none have", "we address", "we tackle",
        "our goal", "aim",
    ],
    "method": [
        "we use", "we propose", "we present", "we introduce", "approach", "method", "model", "framework",
        "technique",
    ],
    "contribution": [
        "we propose", "we present", "we introduce", "we develop", "we describe", "we show",
        "this paper describes", "contribution",
    ],
    "limitation": [
        "limitation", "not possible", "could not", "restricted", "retrospective", "does not", "cannot",
        "future work",
    ],
    "future_work": ["future work", "in future", "future research", "we hope", "plan to", "could be extended"],
}
# Nouns counted by sample claims, and metric names in order of preference.
SAMPLE_NOUNS = (
    "projects?|participants?|subjects?|documents?|papers?|systems?|products?|repositories?|modules?|files?|cases?"
)
METRIC_ORDER = [
    "linear correlation coefficient", "correlation coefficient", "prediction inaccuracy", "inaccuracy",
    "accuracy", "precision", "recall", "f1 score", "f1", "auc", "roc", "rmse", "mae", "mse", "perplexity",
]
RESULT_ROLES = ("abstract", "evaluation", "results", "discussion", "conclusion")
RESULT_WORDS = (
    "result|found|achieved|confirm|correlation|accuracy|inaccuracy|improvement|performed|compared|outperform|good fit"
)


def term_rows(terms: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """(type, term) in matching order: types as given, longer terms first."""
    source = ENTITY_TERMS if terms is None else terms
    return [(kind, t) for kind, words in source.items() for t in sorted(words, key=len, reverse=True)]
