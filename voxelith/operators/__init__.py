"""DataFrame operators on clouds, voxels, meshes and manifests."""
