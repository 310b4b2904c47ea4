"""Word lists and thresholds of the analyses."""

# Results depend on these lists.
TRACKED_VOCABULARY = [
    "delve", "delves", "delved", "delving", "underscore", "underscores", "underscored", "underscoring",
    "nuanced", "nuance", "nuances", "multifaceted", "foster", "fosters", "fostered", "fostering",
    "landscape", "landscapes", "tapestry", "tapestries", "crucial", "crucially", "arguably", "notably",
    "paramount", "intricate", "intricately", "comprehensive", "comprehensively", "robust", "robustly",
    "leverage", "leverages", "leveraged", "leveraging", "harness", "harnessing", "harnessed", "pivotal",
    "realm", "realms", "vibrant", "dynamic", "dynamics", "holistic", "holistically", "groundbreaking",
    "innovative", "innovation", "transformative", "unprecedented", "synergy", "synergies", "synergistic",
    "streamline", "streamlines", "streamlined", "ecosystem", "ecosystems",
]
STOPWORDS = (
    "the a an and or but in on at to for of with by from up about into through during is are was were be been being "
    "have has had do does did will would could should may might shall can i you he she it we they me him her us them "
    "my your his its our their this that these those who which what where when how why whom not no nor so yet as if "
    "then because while although though unless since also just more most than very too only even still after before "
    "over under same other such each own s t re ve ll d m"
).split()
FUNCTION_WORDS = (
    "the a an and or but in on at to for of with by from up about into through during including until against among "
    "throughout despite towards upon concerning is are was were be been being have has had do does did will would "
    "could should may might shall can need i you he she it we they me him her us them my your his its our their this "
    "that these those who which what where when how why whom not no nor so yet both either neither each few more most "
    "other some such than too very just as if then because while although though unless since"
).split()
REMOVED_TAGS = ["script", "style", "noscript", "iframe", "nav", "header", "footer", "aside"]
REMOVED_SELECTORS = [
    ".widget", ".sidebar", ".site-header", ".site-footer", ".navigation", ".nav-links", ".post-navigation",
    ".sharedaddy", ".sd-block", ".jetpack-sharing-buttons", "[class*='share']", "[class*='social']", ".ad", ".advertisement",
    "[class*='banner']", ".author-bio", ".author-box", ".author-description", "[class*='author-info']", ".related-posts",
    "[class*='recommended']", "[class*='more-stories']", "[class*='subscribe']", "[class*='newsletter']", ".wp-caption-text",
    "figcaption", "#comments", ".comments-area", ".breadcrumbs", ".breadcrumb", ".entry-footer", ".post-tags", ".cat-links",
    ".more-link", ".page-links", "[aria-label='advertisement']",
]
CONTENT_SELECTORS = [".entry-content", ".post-content", ".article-content", "[itemprop='articleBody']", "article .content", "article", "main"]
"""Word lists and thresholds of the analyses."""

# Results depend on these lists.
TRACKED_VOCABULARY = [
    "delve", "delves", "delved", "delving", "underscore", "underscores", "underscored", "underscoring",
    "nuanced", "nuance", "nuances", "multifaceted", "foster", "fosters", "fostered", "fostering",
    "landscape", "landscapes", "tapestry", "tapestries", "crucial", "crucially", "arguably", "notably",
    "paramount", "intricate", "intricately", "comprehensive", "comprehensively", "robust", "robustly",
    "leverage", "leverages", "leveraged", "leveraging", "harness", "harnessing", "harnessed", "pivotal",
    "realm", "realms", "vibrant", "dynamic", "dynamics", "holistic", "holistically", "groundbreaking",
    "innovative", "innovation", "transformative", "unprecedented", "synergy", "synergies", "synergistic",
    "streamline", "streamlines", "streamlined", "ecosystem", "ecosystems",
]
STOPWORDS = (
    "the a an and or but in on at to for of with by from up about into through during is are was were be been being "
    "have has had do does did will would could should may might shall can i you he she it we they me him her us them "
    "my your his its our their this that these those who which what where when how why whom not no nor so yet as if "
    "then because while although though unless since also just more most than very too only even still after before "
    "over under same other such each own s t re ve ll d m"
).split()
FUNCTION_WORDS = (
    "the a an and or but in on at to for of with by from up about into through during including until against among "
    "throughout despite towards upon concerning is are was were be been being have has had do does did will would "
    "could should may might shall can need i you he she it we they me him her us them my your his its our their this "
    "that these those who which what where when how why whom not no nor so yet both either neither each few more most "
    "other some such than too very just as if then because while although though unless since"
).split()
REMOVED_TAGS = ["script", "style", "noscript", "iframe", "nav", "header", "footer", "aside"]
REMOVED_SELECTORS = [
    ".widget", ".sidebar", ".site-header", ".site-footer", ".navigation", ".nav-links", ".post-navigation",
    ".sharedaddy", ".sd-block", ".jetpack-sharing-buttons", "[class*='share']", "[class*='social']", ".ad", ".advertisement",
    "[class*='banner']", ".author-bio", ".author-box", ".author-description", "[class*='author-info']", ".related-posts",
    "[class*='recommended']", "[class*='more-stories']", "[class*='subscribe']", "[class*='newsletter']", ".wp-caption-text",
    "figcaption", "#comments", ".comments-area", ".breadcrumbs", ".breadcrumb", ".entry-footer", ".post-tags", ".cat-links",
    ".more-link", ".page-links", "[aria-label='advertisement']",
]
CONTENT_SELECTORS = [".entry-content", ".post-content", ".article-content", "[itemprop='articleBody']", "article .content", "article", "main"]
#: Numeric columns of the article metrics.
MEASURES = [
    "token_count", "sentence_count", "avg_sentence_len", "med_sentence_len", "unique_word_count", "ttr", "root_ttr", "mattr", "hapax_ratio",
    "func_word_ratio", "flesch_reading_ease", "flesch_kincaid_grade", "automated_readability_index", "smog_index",
]
