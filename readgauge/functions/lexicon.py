"""Word lists used by the lexical measures."""

# The connectives whose presence counts as an explicit discourse relation.
CONNECTIVES = (
    "because", "since", "as", "so", "therefore", "thus", "hence", "consequently",
    "as a result", "due to",
    "however", "but", "although", "though", "even though", "nevertheless", "nonetheless",
    "yet", "on the other hand", "in contrast",
    "and", "also", "moreover", "furthermore", "in addition", "besides", "plus",
    "then", "next", "after that", "subsequently",
    "if", "unless", "provided that", "in case", "only if",
    "when", "while", "before", "after", "as soon as", "once", "until",
    "like", "as if", "as though", "than",
    "for example", "for instance", "in fact", "indeed",
    "in conclusion", "to sum up", "overall", "finally",
)

# The five rhetorical roles of a scientific abstract.
ROLES = ("background", "objective", "methods", "results", "conclusions")

# Words that open a subordinate, relative or coordinated clause.
CLAUSE_MARKERS = (
    "after", "although", "and", "as", "because", "before", "but", "if", "nor", "or",
    "since", "so", "than", "that", "though", "unless", "until", "when", "where",
    "whereas", "whether", "which", "while", "who", "whom", "whose", "yet",
)

# Function words of four letters or more; shorter words are no content words anyway.
STOP_WORDS = (
    "about", "above", "after", "again", "also", "although", "among", "because", "been",
    "before", "being", "below", "between", "both", "could", "does", "doing", "down",
    "during", "each", "even", "ever", "from", "further", "have", "having", "here",
    "however", "into", "itself", "just", "many", "more", "most", "much", "must", "once",
    "only", "other", "ours", "over", "same", "shall", "should", "since", "some", "such",
    "than", "that", "their", "theirs", "them", "then", "there", "these", "they", "this",
    "those", "through", "thus", "under", "until", "upon", "very", "were", "what", "when",
    "where", "whereas", "which", "while", "whom", "whose", "will", "with", "within",
    "without", "would", "your", "yours",
)

# Cue words per role, tried in this order; a sentence without any is background.
ROLE_CUES = {
    "objective": ("aim", "aimed", "aims", "goal", "hypothesize", "hypothesized", "investigate",
                  "objective", "purpose", "sought"),
    "conclusions": ("conclude", "concluded", "conclusion", "conclusions", "imply", "suggest",
                    "suggesting", "suggests", "therefore", "thus"),
    "results": ("decreased", "found", "increased", "observed", "result", "results", "revealed",
                "showed", "significant", "significantly"),
    "methods": ("analyzed", "collected", "measured", "method", "methods", "performed",
                "randomized", "used", "using"),
}
