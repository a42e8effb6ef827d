"""seqloom.sources"""
