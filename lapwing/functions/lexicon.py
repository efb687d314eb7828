"""Word lists of the matching rules.

Fixed values: they must be as they are for results to be right.  Every rule that
uses one takes another list as a parameter.
"""

#: Terms of the trade; short spans that hold nothing else weigh little.
COMMON_PHRASES = (
    "binary search tree",
    "binary search trees",
    "balanced binary search tree",
    "balanced binary search trees",
    "red black tree",
    "red black trees",
    "avl tree",
    "avl trees",
    "self balancing binary search",
    "data structure",
    "data structures",
    "time complexity",
    "space complexity",
    "worst case",
    "worst case complexity",
    "worst case cost",
    "average case",
    "best case",
    "big o notation",
    "logarithmic time",
    "linear time",
    "quadratic time",
    "database management system",
    "relational database",
    "relational algebra",
    "normal form",
    "normal forms",
    "acid properties",
    "transaction management",
    "concurrency control",
    "tcp ip",
    "tcp congestion control",
    "socket programming",
    "layered architecture",
    "layered architectures",
    "finite element analysis",
    "finite element approximations",
    "static equilibrium",
    "stress analysis",
    "digital electronics",
    "synchronous state machine",
    "logic synthesis",
    "hardware testbench",
    "fast fourier transform",
    "discrete fourier transform",
    "ohms law",
    "kirchhoffs voltage law",
    "kirchhoffs current law",
    "central processing unit",
    "operating system",
    "virtual memory",
    "dynamic programming",
    "depth first search",
    "breadth first search",
    "graph algorithm",
    "graph algorithms",
    "object oriented programming",
    "functional programming",
    "machine learning",
    "deep learning",
    "artificial intelligence",
    "convolutional neural network",
    "recurrent neural network",
    "transformer architecture",
    "attention mechanism",
    "gradient descent",
    "backpropagation",
    "stochastic gradient descent",
    "loss function",
    "overfitting",
    "underfitting",
    "cross validation",
    "hyperparameter tuning",
    "principal component analysis",
    "support vector machine",
    "random forest",
    "linear regression",
    "logistic regression",
)

#: Textbook definitions, normalised.
DEFINITIONS = (
    "binary search tree is a rooted binary tree data structure with the key in each internal node greater than all keys in its left subtree and less than all keys in its right subtree",
    "an avl tree is a self balancing binary search tree where the heights of two child subtrees of any node differ by at most one",
    "a red black tree is a self balancing binary search tree with one extra bit of storage per node representing color",
    "time complexity is the computational complexity that describes the amount of computer time it takes to run an algorithm",
    "space complexity is a measure of the amount of working storage or memory that an algorithm needs",
    "big o notation is a mathematical notation that describes the limiting behavior of a function when the argument tends towards a particular value or infinity",
    "kirchhoffs current law states that the algebraic sum of currents entering any node in a circuit is equal to zero",
    "kirchhoffs voltage law states that the directed sum of potential differences around any closed loop is zero",
    "finite element analysis is a numerical method for solving differential equations in engineering and mathematical modeling",
    "dynamic programming is an algorithmic paradigm that solves complex problems by breaking them into simpler subproblems and storing intermediate solutions",
    "breadth first search traverses a graph level by level starting from a root node",
    "depth first search explores as far as possible along each branch before backtracking",
    "ohms law states that the current through a conductor between two points is directly proportional to the voltage across the two points",
)

#: Framing phrases of academic prose.
BOILERPLATE = (
    "as shown in figure",
    "as shown in table",
    "as illustrated in figure",
    "as depicted in figure",
    "the experimental results show",
    "the results are presented in",
    "in this report we present",
    "in this paper we propose",
    "the remainder of this report is organized as follows",
    "the rest of this paper is organized as follows",
    "as discussed in the previous section",
    "in order to evaluate the performance",
    "for the purpose of this analysis",
    "it is important to note that",
    "on the other hand",
    "in contrast to",
    "with respect to",
    "in accordance with",
    "based on the above observations",
    "it can be observed that",
    "the following section describes",
    "submitted for academic integrity evaluation",
    "department of computer engineering",
    "department of electrical engineering",
    "department of mechanical engineering",
    "abc institute of technology",
    "in conclusion the experimental results",
    "all rights reserved",
    "submitted in partial fulfillment of the requirements",
    "for the degree of bachelor of technology",
    "under the guidance of",
    "table of contents",
    "list of figures",
    "list of tables",
)

#: Phrases that are never search queries.
GENERIC_PHRASES = (
    "this paper presents",
    "in this paper we present",
    "in this study we",
    "the proposed method",
    "results show that",
    "as shown in figure",
    "as shown in table",
    "in this section we",
    "it can be seen that",
    "it is well known that",
    "future work will",
    "in conclusion we have",
    "the experimental results demonstrate",
    "on the other hand",
    "in addition to this",
    "due to the fact that",
    "for the purpose of",
    "in order to achieve",
    "the remainder of this paper",
    "is organized as follows",
    "we evaluate the performance of",
    "with respect to the",
    "based on the above",
)

#: Terms whose density the style report counts.
MARKER_TERMS = (
    "delve",
    "delves",
    "delving",
    "tapestry",
    "crucial",
    "paramount",
    "in conclusion",
    "it is worth noting",
    "serves as a testament",
    "sheds light on",
    "plays a vital role",
    "a plethora of",
    "in summary",
    "underscores the importance",
    "furthermore",
    "moreover",
    "consequently",
    "seamlessly",
    "testament",
    "holistic",
    "fosters",
    "navigating the complexities",
)

#: English words that carry no content.
STOPWORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been",
    "before", "being", "below", "between", "both", "but", "by", "could", "did", "do", "does", "doing", "down", "during", "each", "few",
    "for", "from", "further", "had", "has", "have", "having", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "i",
    "if", "in", "into", "is", "it", "its", "itself", "just", "me", "more", "most", "my", "myself", "no", "nor", "not", "of", "off", "on",
    "once", "only", "or", "other", "ought", "our", "ours", "ourselves", "out", "over", "own", "same", "she", "should", "so", "some", "such",
    "than", "that", "the", "their", "theirs", "them", "themselves", "then", "there", "these", "they", "this", "those", "through", "to",
    "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "with",
    "would", "you", "your", "yours", "yourself",
)

#: Words to the group of synonyms they belong to.
SYNONYMS = {
    "ascending": "syn_order",
    "descending": "syn_order",
    "sorted": "syn_order",
    "sequential": "syn_linear",
    "linear": "syn_linear",
    "scanning": "syn_search",
    "search": "syn_search",
    "queries": "syn_search",
    "hierarchy": "syn_tree",
    "tree": "syn_tree",
    "trees": "syn_tree",
    "subtrees": "syn_tree",
    "rotational": "syn_rotation",
    "rotation": "syn_rotation",
    "rotations": "syn_rotation",
    "pivots": "syn_rotation",
    "elevations": "syn_height",
    "elevation": "syn_height",
    "height": "syn_height",
    "heights": "syn_height",
    "unity": "syn_unit",
    "single": "syn_unit",
    "threshold": "syn_bound",
    "limit": "syn_bound",
    "bounding": "syn_bound",
    "logarithmic": "syn_log",
    "log": "syn_log",
    "degradation": "syn_degrade",
    "degenerates": "syn_degrade",
    "breakdown": "syn_degrade",
    "updates": "syn_modify",
    "modification": "syn_modify",
    "insertion": "syn_modify",
    "sibling": "syn_branch",
    "branch": "syn_branch",
    "balancing": "syn_balance",
    "balanced": "syn_balance",
    "balance": "syn_balance",
    "computational": "syn_complexity",
    "complexity": "syn_complexity",
}
