"""The registered queries of the operators and their SQL, where SQL can express them."""

from __future__ import annotations

from .mixing import op3_mix_sources
from .neighbours import op4_hilbert_neighbours
from .ogg import op10_ogg_media
from .packing import op2_pack_best_fit
from .simhash import op9_simhash_components
from .sharding import op6_shard_best_fit
from .substrings import op7_repeated_substrings
from .tokenstore import op8_token_store
from .surrogates import op1_surrogates
from .toxicity import op5_weak_toxicity

QUERIES = {f.__name__: f for f in (op1_surrogates, op2_pack_best_fit, op3_mix_sources, op4_hilbert_neighbours, op5_weak_toxicity, op6_shard_best_fit, op7_repeated_substrings, op8_token_store, op9_simhash_components, op10_ogg_media)}
#: Brute force over all pairs, which the search's exact check equals at every size. The others have hash orders, learned
#: weights, packings or file formats, which SQL has no form for.
SQL: dict[str, str] = {
    "op4_hilbert_neighbours": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS u FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e) AS score, q.u AS u FROM v q JOIN v c ON q.u <> c.u AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY round(score, 12) DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20""",
}
