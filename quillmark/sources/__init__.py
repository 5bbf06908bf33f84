"""Reading file trees, rules, build descriptors and snapshots; writing bundles, snapshots and blobs."""
