"""tetrad: labelled-text classification data on Spark.

Every public function takes and returns DataFrames. Sub-packages:

- ``sources``   reading/writing posts, vocabularies, dataset variants, models
- ``functions`` Column-level helpers (text, bits, arrays, softmax)
- ``operators`` DataFrame operators (exact rank, resampling, wordpiece, ranking,
                batching, sessions, metrics, models)
- ``plans``     fixtures and the registered queries
- ``streaming`` the stateful running-transcript job
"""

from tetrad.session import checkpoint_dir, clean, get_session, materialize  # noqa: F401

__all__ = ["get_session", "checkpoint_dir", "clean", "materialize"]
