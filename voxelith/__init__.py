"""Spark-native operators for large point and splat clouds, sparse voxels, LOD manifests and document corpora."""
