"""Readers for contributed files and the node store."""
