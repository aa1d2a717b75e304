"""quarrylight.operators"""
