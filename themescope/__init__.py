"""themescope: find and follow opinion themes in large post collections with Spark.

Every public function takes and returns DataFrames (``df.transform``-friendly);
nothing is collected except k-row results (centres, cluster statistics) whose
size is checked before they are inlined into a plan.
"""

__version__ = "0.1.0"
